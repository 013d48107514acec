"""Text normal forms, n-grams, pattern findings and keyword categories."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.scratch import Scratch

# What a number looks like, and the ideographs kept beside letters and digits.
_NUMBER = re.compile(r"\d+(?:[./:-]\d+)*")
_OTHER = re.compile("(?:[^\\w<>㐀-鿿]|_)+")
_WORD = re.compile(r"[^\W_]+")

# Patterns of personal data. Java's classes are ASCII without (?U).
PATTERNS = {
    "mainland_mobile_number": r"(?U)(?<!\d)1[3-9]\d{9}(?!\d)",
    "mainland_identity_number": r"(?U)(?<!\d)\d{17}[\dXx](?!\d)",
    "long_account_like_number": r"(?U)(?<!\d)\d{12,19}(?!\d)",
    "email_address": r"(?iU)(?<![\w.])[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}(?![\w.])",
    "ipv4_address": r"(?U)(?<!\d)(?:\d{1,3}\.){3}\d{1,3}(?!\d)",
    "credential_assignment": r"(?iU)(?:password|passwd|api[_-]?key|access[_-]?token|secret[_-]?key)\s*[:=]",
    "explicit_chinese_identifier_disclosure": r"(?U)(?:身份证(?:号|号码)?|手机(?:号|号码)?|银行卡号|账户号|账号)\s*(?:是|为|[:：])",
}


def normal_form(text: str) -> str:
    """Compatibility form, lower case, numbers as <num>, words apart by single blanks."""
    value = _NUMBER.sub("<num>", unicodedata.normalize("NFKC", text).lower())
    return _OTHER.sub(" ", value).strip()


def compact_form(text: str) -> str:
    """Compatibility form, lower case, letters and digits only."""
    return "".join(_WORD.findall(unicodedata.normalize("NFKC", text).lower()))


@F.pandas_udf(T.StringType())
def normalized(texts: pd.Series) -> pd.Series:
    """``normal_form`` of each text; null stays null."""
    return texts.map(normal_form, na_action="ignore")


@F.pandas_udf(T.StringType())
def compacted(texts: pd.Series) -> pd.Series:
    """``compact_form`` of each text; null stays null."""
    return texts.map(compact_form, na_action="ignore")


def dialogue_line(dialogue: Column) -> Column:
    """All turns as "role text", joined by blanks."""
    return F.array_join(F.transform(dialogue, lambda t: F.concat_ws(" ", t["role"], t["text"])), " ")


def ngrams(text: Column, n: int) -> Column:
    """Distinct runs of ``n`` characters; none for a shorter text."""
    starts = F.sequence(F.lit(1), F.length(text) - (n - 1))
    return F.when(F.length(text) >= n, F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(n))))).otherwise(
        F.array().cast("array<string>")
    )


def findings(texts: DataFrame, key: Sequence[str], text: str, patterns: Mapping[str, str] = PATTERNS) -> DataFrame:
    """(key..., kind): at most one finding of each kind in a text."""
    kinds = F.array_compact(F.array(*[F.when(F.col(text).rlike(p), F.lit(k)) for k, p in patterns.items()]))
    return texts.select(*key, F.explode(kinds).alias("kind"))


def stripped_tags(text: Column) -> Column:
    """Without tags, whitespace collapsed, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, "<[^>]*>", " "), r"(?U)\s+", " "))


def categories(text: Column, terms: Mapping[str, Sequence[str]]) -> Column:
    """Array of (category, evidence) for every category of which a term occurs in the text."""
    entries = []
    for category, words in terms.items():
        hit = F.array_compact(F.array(*[F.when(F.contains(text, F.lit(w)), F.lit(w)) for w in words]))
        entries.append(F.when(F.size(hit) > 0, F.struct(F.lit(category).alias("category"), hit.alias("evidence"))))
    return F.array_compact(F.array(*entries))


#: Bits of the filter of clause grams; 2 MB whatever the input.
FILTER_BITS = 1 << 24
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def _mixed(high: np.ndarray, low: np.ndarray, base: int) -> np.ndarray:
    out = high * np.uint64(base) + low
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(29)
    return out


def _run_hashes(texts: Sequence[str | None], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hashes): two 64-bit hashes of every run of ``n`` characters of each text, repeated ones too.

    All texts are hashed as one, and runs that cross from one into the next left out. The
    hash of a run is put together from those of runs of half its length.
    """
    points = [np.frombuffer((t or "").encode("utf-32-le", "surrogatepass"), dtype=np.uint32) for t in texts]
    lengths = np.array([len(p) for p in points], dtype=np.int64)
    whole = np.concatenate([*points, np.zeros(0, dtype=np.uint32)]).astype(np.uint64)
    size = max(len(whole) - n + 1, 0)
    rows = np.repeat(np.arange(len(points)), lengths)[:size]
    inside = np.arange(size) + n <= np.cumsum(lengths)[rows] if size else np.zeros(0, dtype=bool)
    out = np.zeros((2, int(inside.sum())), dtype=np.uint64)
    for k, base in enumerate(_BASES if size else ()):
        power, done, length = _mixed(whole + np.uint64(1), whole, base), None, 0
        for bit in range(n.bit_length()):
            run = 1 << bit
            if n & run:
                done, length = (power, run) if done is None else (_mixed(done[: len(whole) - length - run + 1], power[length:], base), length + run)
            if 2 * run <= n:
                power = _mixed(power[:-run], power[run:], base)
        out[k] = done[:size][inside]
    return rows[inside], out


def gram_hashes(texts: Sequence[str | None], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hashes): two 64-bit hashes of each distinct run of ``n`` characters of each text; none for null and shorter texts."""
    rows, out = _run_hashes(texts, n)
    order = np.lexsort((out[1], out[0], rows))
    rows, out = rows[order], out[:, order]
    fresh = np.ones(len(rows), dtype=bool)
    fresh[1:] = (rows[1:] != rows[:-1]) | (out[:, 1:] != out[:, :-1]).any(axis=0)
    return rows[fresh], out[:, fresh]


def _hashed_grams(n: int, filter_words: object = None, bits: int = FILTER_BITS, by: int = 0):
    """(key, h1, h2) of every distinct gram of each text, of those the filter, by hash number ``by``, lets pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                rows, found = gram_hashes(part.column(1).to_pylist(), n)
                if filter_words is not None:
                    kept = _has(filter_words.value, found[by] & np.uint64(bits - 1))
                    rows, found = rows[kept], found[:, kept]
                h1, h2 = (pa.array(np.ascontiguousarray(h).view(np.int64)) for h in found)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows)), h1, h2], names=[batch.schema.names[0], "h1", "h2"])

    return run


def gram_overlap(texts: DataFrame, text_key: str, clauses: DataFrame, clause_key: str, n: int) -> DataFrame:
    """(text_key, clause_key, shared): how many distinct n-grams of the ``text`` columns two sides share.

    Grams are 128-bit hashes. Those of the clauses set bits in a filter of fixed size, so of
    the texts only grams that some clause may hold leave their task; the join on the hash
    decides. Null texts share nothing; rows repeated under a key count for each row.
    """
    spark = texts.sparkSession

    def grams(df: DataFrame, key: str, words: object = None) -> DataFrame:
        two = df.select(key, "text")
        return two.mapInArrow(_hashed_grams(n, words), f"`{key}` {two.schema[0].dataType.simpleString()}, h1 long, h2 long")

    held = grams(clauses, clause_key)
    slots = held.select(F.pmod("h1", F.lit(FILTER_BITS)).alias("slot"))
    bits = slots.select(F.shiftright("slot", 6).alias("word"), F.expr("shiftleft(1L, CAST(slot % 64 AS INT))").alias("bit"))
    table = np.zeros(FILTER_BITS // 64, dtype=np.uint64)
    for row in bits.groupBy("word").agg(F.bit_or("bit").alias("bits")).toLocalIterator():
        table[row.word] = row.bits & (2**64 - 1)
    found = grams(texts, text_key, spark.sparkContext.broadcast(table))
    return found.join(held, ["h1", "h2"]).groupBy(text_key, clause_key).agg(F.count("*").alias("shared"))


#: Bits of the filters of ``overlap_counts`` for each character of the clauses, and the most there are (32 MB).
BITS_A_CHARACTER, MOST_BITS = 8, 1 << 28


def _has(words: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (words[(slots >> np.uint64(6)).astype(np.int64)] >> (slots & np.uint64(63))) & np.uint64(1) == 1


def _set_bits(seen: np.ndarray) -> pa.RecordBatch:
    at = np.nonzero(seen)[0]
    return pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(seen[at].view(np.int64))], names=["word", "bits"])


def _filter(parts: DataFrame, bits: int) -> np.ndarray:
    """One filter of the (word, bits) that tasks have set."""
    found = parts.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    table = np.zeros(bits // 64, dtype=np.uint64)
    table[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return table


def _marking(n: int, bits: int, clause_words: object = None):
    """(word, bits) set by the grams of clauses, or, with the clauses' filter, by those of texts that pass it."""
    mask = np.uint64(bits - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(bits // 64, dtype=np.uint64)
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                _, found = _run_hashes(batch.column("text").slice(start, 500).to_pylist(), n)
                if clause_words is None:
                    slots = np.concatenate([found[0] & mask, (found[0] >> np.uint64(32)) & mask])
                else:
                    slots = found[1][_passes(clause_words.value, found[0], mask)] & mask
                np.bitwise_or.at(seen, (slots >> np.uint64(6)).astype(np.int64), np.uint64(1) << (slots & np.uint64(63)))
        yield _set_bits(seen)

    return run


def _passes(words: np.ndarray, h1: np.ndarray, mask: np.uint64) -> np.ndarray:
    kept = _has(words, h1 & mask)
    kept[kept] = _has(words, (h1[kept] >> np.uint64(32)) & mask)
    return kept


class _Grams:
    """Where each gram that a text may share is: its atom, by both hashes."""

    def __init__(self, h1: np.ndarray, h2: np.ndarray, atom: np.ndarray) -> None:
        order = np.lexsort((h2, h1))
        self.h1, self.h2, self.atom = h1[order], h2[order], atom[order].astype(np.int32)
        # Grams that are alike in the first hash are tried one after another.
        self.tries = int(np.unique(self.h1, return_counts=True)[1].max()) if len(h1) else 0

    def places(self, found: np.ndarray) -> np.ndarray:
        """The place of each gram; -1 for those that are not there."""
        first, out = np.searchsorted(self.h1, found[0]), np.full(found.shape[1], -1)
        for i in range(self.tries):
            at = np.minimum(first + i, len(self.h1) - 1)
            out = np.where((self.h1[at] == found[0]) & (self.h2[at] == found[1]), at, out)
        return out


def _atoms_of(n: int, clause_words: object, mask: np.uint64, grams: object):
    """(key, atom, n): how many distinct grams of each text are of each atom."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                rows, found = _run_hashes(part.column(1).to_pylist(), n)
                kept = _passes(clause_words.value, found[0], mask)
                rows, at = rows[kept], grams.value.places(found[:, kept])
                size = len(grams.value.h1)
                # Each gram of a text once, then by its atom.
                once = np.unique(rows[at >= 0] * size + at[at >= 0])
                cells, counts = np.unique(once // max(size, 1) * size + grams.value.atom[once % max(size, 1)], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(cells // max(size, 1))), pa.array(cells % max(size, 1), pa.int32()), pa.array(counts, pa.int32())], names=[batch.schema.names[0], "atom", "n"]
                )

    return run


def _summed(index: object):
    """(key, n_clauses, most_shared) from the atoms of each key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, clause, times = index.value
        for batch in batches:
            clauses, most = [], []
            for atoms, counts in zip(batch.column("atoms"), batch.column("counts"), strict=True):
                at, weight = np.asarray(atoms.values), np.asarray(counts.values)
                begin = starts[at]
                lengths = starts[at + 1] - begin
                ends = np.cumsum(lengths)
                each = np.arange(ends[-1]) + np.repeat(begin - ends + lengths, lengths)
                shared = np.bincount(clause[each], weights=times[each] * np.repeat(weight, lengths))
                clauses.append(np.count_nonzero(shared))
                most.append(int(shared.max()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(clauses, pa.int64()), pa.array(most, pa.int64())], names=[batch.schema.names[0], "n_clauses", "most_shared"])

    return run


def overlap_counts(texts: DataFrame, text_key: str, clauses: DataFrame, clause_key: str, n: int, scratch: Scratch) -> DataFrame:
    """(text_key, n_clauses, most_shared): with how many clauses a text shares n-grams, and the most it shares with one; ``gram_overlap`` summed up by text.

    Pairs are not formed as rows, as boilerplate makes their number grow with the product of
    both sides. Grams that the same clauses hold are one atom; a text is its atoms with
    how many grams it has of each, and each text's clauses are added up in one task from an
    index of atoms. Texts are read twice: first those of their grams that pass a filter of
    the clauses' set the bits of a second filter, so that only clause grams some text
    (nearly surely) holds are looked up; both hashes decide. Broadcast are the filters, 20
    bytes a shared gram, and 20 bytes for each atom of each clause.
    """
    spark = texts.sparkSession
    sc = spark.sparkContext
    held = scratch.save(clauses.select(clause_key, "text"), "clauses")
    characters = held.agg(F.sum(F.length("text"))).first()[0] or 0
    bits = min(MOST_BITS, 1 << max(16, (BITS_A_CHARACTER * characters).bit_length()))
    mask = np.uint64(bits - 1)
    words = sc.broadcast(_filter(held.mapInArrow(_marking(n, bits), "word long, bits long"), bits))
    two = texts.select(text_key, "text")
    used = sc.broadcast(_filter(two.mapInArrow(_marking(n, bits, words), "word long, bits long"), bits))
    kind = f"`{clause_key}` {held.schema[0].dataType.simpleString()}, h1 long, h2 long"
    rows = scratch.save(held.mapInArrow(_hashed_grams(n, used, bits, 1), kind), "grams")
    # Sums of 40 bits do not overflow; together they tell sets of clauses apart as a 120-bit hash does.
    sums = [F.sum(F.shiftrightunsigned(F.xxhash64(F.col(clause_key), F.lit(i)), 24)).alias(f"s{i}") for i in range(3)]
    found = rows.groupBy("h1", "h2").agg(*sums).toArrow()
    h1, h2, *of_atom = (found[c].to_numpy() for c in ("h1", "h2", "s0", "s1", "s2"))
    order = np.lexsort(of_atom)
    of_atom = np.array([c[order] for c in of_atom])
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = (of_atom[:, 1:] != of_atom[:, :-1]).any(axis=0)
    atom = np.empty(len(order), dtype=np.int64)
    atom[order] = np.cumsum(fresh) - 1
    # One gram stands for its atom; its clauses are the atom's.
    one = order[fresh]
    named = spark.createDataFrame(pa.table({"h1": h1[one], "h2": h2[one], "atom": atom[one]}), "h1 long, h2 long, atom long")
    entries = rows.join(named, ["h1", "h2"]).groupBy("atom", clause_key).agg(F.count("*").alias("times")).toArrow()
    scratch.drop(rows, held)
    order = np.argsort(entries["atom"].to_numpy(), kind="stable")
    starts = np.searchsorted(entries["atom"].to_numpy()[order], np.arange(len(one) + 1))
    number = entries[clause_key].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
    index = sc.broadcast((starts, number[order], entries["times"].to_numpy()[order]))
    grams = sc.broadcast(_Grams(h1.view(np.uint64), h2.view(np.uint64), atom))
    key = f"`{text_key}` {two.schema[0].dataType.simpleString()}"
    parts = two.mapInArrow(_atoms_of(n, words, mask, grams), f"{key}, atom int, n int")
    lists = parts.groupBy(text_key).agg(F.collect_list("atom").alias("atoms"), F.collect_list("n").alias("counts"))
    return lists.mapInArrow(_summed(index), f"{key}, n_clauses long, most_shared long")


# Markers that must not be in a released file, archives, and patterns of infrastructure and people.
OPERATIONAL_MARKERS = (
    "private_selection_provenance", "private_diversity_repair_provenance", "selected_task_id", "review_id", "request_payload", "response_payload",
    "chat_completions_url", "credential_env", "not_public_release", "not_yet_published",
)
LOCAL_MARKERS = ("F:\\", "C:\\Users\\", "/Users/", "/home/", "_private_do_not_send", "api_key=", "authorization: bearer", "/chat/completions")
ARCHIVES = (".tar.gz", ".tgz", ".zip", ".7z")
INFRASTRUCTURE = (
    r"(?U)(?<!\d)(?:10|192\.168|172\.(?:1[6-9]|2\d|3[01]))(?:\.\d{1,3}){2}(?!\d)",
    r"/(?:root|opt|home|srv)/[A-Za-z0-9_./-]+",
)
PERSONAL = (r"(?U)[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}", r"(?U)\b1[3-9]\d{9}\b")


def policy_findings(files: DataFrame, key: str, path: str, text: str, exceptions: Sequence[str] = ()) -> DataFrame:
    """(key, finding): files of a release that break its policy: nested archives, operational or local markers, infrastructure, personal data.

    Excepted paths are not read further than their name; a null text only has a name.
    """
    value, name = F.coalesce(F.col(text), F.lit("")), F.lower(F.col(path))

    def any_of(tests: list[Column]) -> Column:
        found = F.lit(False)
        for test in tests:
            found = found | test
        return found

    read = ~F.coalesce(F.col(path).isin(*exceptions), F.lit(False)) if exceptions else F.lit(True)
    kinds = {
        "nested archive": F.coalesce(any_of([F.endswith(name, F.lit(a)) for a in ARCHIVES]), F.lit(False)),
        "operational marker": read & any_of([F.contains(value, F.lit(t)) for t in OPERATIONAL_MARKERS]),
        "local marker": read & any_of([F.contains(F.lower(value), F.lit(t.lower())) for t in LOCAL_MARKERS]),
        "infrastructure": read & any_of([value.rlike(p) for p in INFRASTRUCTURE]),
        "personal data": read & any_of([value.rlike(p) for p in PERSONAL]),
    }
    found = F.array_compact(F.array(*[F.when(test, F.lit(kind)) for kind, test in kinds.items()]))
    return files.select(key, F.explode(found).alias("finding"))


def absolute_url(url: Column, scheme: str = "https") -> Column:
    """A URL without scheme gets one."""
    return F.when(url.startswith("//"), F.concat(F.lit(f"{scheme}:"), url)).otherwise(url)


def record_id(*parts: Column) -> Column:
    """The first 20 hex digits of the digest of the parts."""
    return F.substring(F.sha2(F.concat_ws("|", *parts).cast("binary"), 256), 1, 20)


def percent(value: Column, digits: int = 1) -> Column:
    """A share as a percentage text."""
    return F.concat(F.format_number(value * 100, digits), F.lit("%"))
