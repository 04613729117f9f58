"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders, so that a question whose parameters were changed still has the template of the original. Windows of template words are hash-joined with those of the benchmark, an item's rarest windows first; a match counts only where its slots can be filled consistently: each value of the item stands for one value in the document.
"""

from __future__ import annotations

import sys
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import vec
from .shared import cut, join_groups

WORDS = 5  # words in a template window
SHARE = 0.8  # of an item's windows that a document must hold consistently
LITERALS = 2  # words of a window that are no placeholders, at least (or all words of a shorter item)
FORMS = 3  # ways to take names: see forms()
PARTS_KNOWN = 100_000  # parts of a search that are remembered at a time
INDEX_WINDOWS = 2_000_000  # windows of the benchmark that go to every task; a larger benchmark is joined by a shuffle

#: Units and number words that become placeholders. Units that are common English words (in, a, as) are left out.
UNITS = "km kilometer kilometers kilometre kilometres cm centimeter centimeters mm millimeter millimeters meter meters metre metres mile miles foot feet inch inches yard yards kg kilogram kilograms gram grams mg pound pounds lb lbs ounce ounces oz ton tons liter liters litre litres ml gallon gallons cup cups second seconds sec minute minutes min hour hours hr hrs day days week weeks month months year years dollar dollars usd cent cents euro euros eur percent mph kmh kph degree degrees celsius fahrenheit watt watts kw kwh volt volts joule joules newton newtons hz khz mhz ghz kb mb gb tb".split()
NUMBERS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen half twice thrice".split()

_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_SIGN = np.zeros(256, bool)  # ASCII signs, cut from both ends of a word
_SIGN[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_STOP = np.zeros(256, bool)
_STOP[[33, 46, 58, 63]] = True  # ! . : ?
NUM, UNIT, NAME = (vec.U(x) for x in (0xA1, 0xB2, 0xC3))


def _known(words: list[str]) -> np.ndarray:
    data = np.frombuffer("".join(words).encode(), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    return np.sort(vec.word_hashes(data, ends - [len(w) for w in words], ends))


_UNITS, _NUMBERS = _known(UNITS), _known(NUMBERS)


def _isin(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x


def forms(data: np.ndarray, offsets: np.ndarray):
    """(template, value, word, document) of each word, in each of FORMS ways: the template is the word's hash (signs cut off, A-Z lower-cased) or a placeholder, the value 0 or, for a placeholder, the word's hash; word is the hash whatever the template. Words of signs only are left out; names in a row are one placeholder, its value that of all of them.

    A name is a capitalised word that opens no sentence (first form) or any capitalised word (second); the third form has no names, so it is the same in any case.
    """
    starts, ends, doc = vec.words(data, offsets)
    raw_starts, raw_ends = starts, ends
    starts, ends = vec.trimmed(starts, ends, ~_SIGN[data])
    has_digit = np.concatenate([[0], np.cumsum(_DIGIT[data])])
    first_of_doc = np.append(True, doc[1:] != doc[:-1]) if len(doc) else np.zeros(0, bool)
    opens = first_of_doc.copy()  # a sentence's first word may be capitalised without being a name
    if len(doc):
        line = np.concatenate([[0], np.cumsum(data == 10)])
        opens[1:] |= _STOP[data[raw_ends[:-1] - 1]] | (line[raw_starts[1:]] > line[raw_ends[:-1]])
    keep = starts < ends
    starts, ends, doc, opens = starts[keep], ends[keep], doc[keep], opens[keep]
    h = vec.word_hashes(data, starts, ends)
    number = (has_digit[ends] > has_digit[starts]) | _isin(h, _NUMBERS)
    unit = ~number & _isin(h, _UNITS)
    capital = ~number & ~unit & _UPPER[data[starts]] if len(h) else np.zeros(0, bool)
    for name in (capital & ~opens, capital, np.zeros(len(h), bool)):
        word, follows = h.copy(), np.zeros(len(h), bool)
        if name.any():
            follows[1:] = name[1:] & name[:-1] & (doc[1:] == doc[:-1])
            chain = np.flatnonzero(follows)
            head = np.maximum.accumulate(np.where(follows, 0, np.arange(len(h))))
            with np.errstate(over="ignore"):
                np.add.at(word, head[chain], vec.mix(h[chain] + (chain - head[chain]).astype(vec.U)))
        template = np.where(number, NUM, np.where(unit, UNIT, np.where(name, NAME, word)))
        value = np.where(number | unit | name, word, vec.U(0))
        yield template[~follows], value[~follows], word[~follows], doc[~follows]


def _next(acc: np.ndarray, word: np.ndarray) -> np.ndarray:
    return vec.mix(acc * vec.U(0xD6E8FEB86659FD93) + word, 5)


def windows(form: int, template: np.ndarray, value: np.ndarray, word: np.ndarray, doc: np.ndarray, k: int, n_docs: int, lengths: list[int] | None):
    """(document, hash, values of k slots) of the windows of each of `lengths` words, k at most; None: of k words, or of the whole text where it has fewer. A window with too few literal words is left out; in the last form its words are taken as they are, without slots, so a copy has all windows of its item."""
    n = len(template)
    count = np.bincount(doc, minlength=n_docs)
    place = np.arange(n) - np.repeat(np.cumsum(count) - count, count)
    left = count[doc] - place
    for size in [None] if lengths is None else lengths:
        if size is None:
            ok, size = (left >= k) | ((place == 0) & (left < k)), np.minimum(left, k)
        else:
            ok, size = left >= size, np.full(n, size)
        acc, literal = np.full(n, form, vec.U), np.zeros(n, np.int64)
        slots = np.zeros((n, k), vec.U)
        for j in range(k):
            here = (size > j) & (left > j)
            t, v = np.zeros(n, vec.U), np.zeros(n, vec.U)
            t[: max(n - j, 0)], v[: max(n - j, 0)] = template[j:], value[j:]
            acc = _next(acc, np.where(here, t, vec.U(0)))
            slots[:, j] = np.where(here, v, vec.U(0))
            literal += here & (slots[:, j] == 0)
        sparse = literal < np.minimum(LITERALS, size)
        if form == FORMS - 1:
            at = np.flatnonzero(ok & sparse)
            plain = np.full(len(at), FORMS, vec.U)
            for j in range(k):
                plain = _next(plain, np.where(size[at] > j, word[np.minimum(at + j, max(n - 1, 0))], vec.U(0)))
            acc[at], slots[at] = plain, 0
        else:
            ok &= ~sparse
        yield doc[ok], acc[ok], slots[ok], size[ok]


HITS = "form int, w long, slots array<long>, words int"


def _hits(k: int, index: np.ndarray | None, lengths: list[int] | None, id_col: str):
    def run(batches):
        import pyarrow as pa

        for part, data, offsets in vec.pieces(batches):
            if not len(data):
                continue
            for form, words in enumerate(forms(data, offsets)):
                for doc, h, slots, size in windows(form, *words, k, part.num_rows, lengths):
                    if index is not None and len(h):
                        found = _isin(h, index) if len(index) else np.zeros(len(h), bool)
                        doc, h, slots, size = doc[found], h[found], slots[found], size[found]
                    if not len(h):
                        continue
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(h) + 1) * k, pa.int32()), pa.array(slots.view(np.int64).ravel()))
                    yield pa.RecordBatch.from_arrays([part.column(id_col).take(pa.array(doc)), pa.array(np.full(len(h), form, np.int32)), pa.array(h.view(np.int64)), lists, pa.array(size.astype(np.int32))], names=[id_col, "form", "w", "slots", "words"])

    return run


def most_held(matches, least: int) -> int:
    """The most windows that one assignment of the item's values to the document's holds, or `least` if none holds more. matches: (window, item's slots, document's slots).

    An exact branch and bound over the item's values. Windows that share no open value are searched apart, and a part that was met before is not searched again, so windows along a text, each with the values of its neighbours only, do not multiply.
    """
    fits: dict = {}
    for w, theirs, ours in matches:
        one: dict = {}
        if all(t == 0 or one.setdefault(t, o) == o for t, o in zip(theirs, ours, strict=True)):
            fits.setdefault(w, set()).add(tuple(sorted(one.items())))
    known: dict = {}  # part -> (most windows, whether that is exact or only a bound)

    # both searches give the exact number if it is over need, else any number up to need; a window is its possible matches, a match its open values
    def apart(rows, need):
        held = sum(() in row for row in rows)
        rows = [row for row in rows if () not in row]
        if held + len(rows) <= need:
            return need
        parts = _parts(rows)
        left = len(rows)
        for part in parts:
            left -= len(part)
            enough = need - held - left
            got = joined(part, enough)
            if got <= enough:
                return need
            held += got
        return held

    def joined(rows, need):
        if len(rows) <= need:
            return need
        key = tuple(sorted(tuple(sorted(row)) for row in rows))
        most, exact = known.get(key, (len(rows), False))
        if exact or most <= need:
            return most
        users = Counter(t for row in rows for t in {t for one in row for t, _ in one})
        t = max(users, key=lambda x: (users[x], x))
        free, support, votes = 0, Counter(), Counter()
        for row in rows:
            values = {dict(one).get(t) for one in row}
            votes.update(values - {None})
            if None in values:
                free += 1
            else:
                support.update(values)
        best = need
        for o in sorted(votes, key=lambda x: (support[x], votes[x], x), reverse=True):
            if free + support[o] <= best:
                break
            chosen = [{tuple(x for x in one if x[0] != t) for one in row if dict(one).get(t, o) == o} for row in rows]
            best = max(best, apart([row for row in chosen if row], best))
        if len(known) >= PARTS_KNOWN:
            known.clear()
        known[key] = best, best > need
        return best

    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(limit + 4 * len({t for row in fits.values() for one in row for t, _ in one}) + 100)
    try:
        return max(least, apart(list(fits.values()), least))
    finally:
        sys.setrecursionlimit(limit)


def _parts(rows: list) -> list[list]:
    """rows in groups that share no value, small groups first."""
    root: dict = {}

    def top(t):
        while root.setdefault(t, t) != t:
            root[t] = t = root[root[t]]
        return t

    for row in rows:
        first, *others = {t for one in row for t, _ in one}
        for t in others:
            root[top(t)] = top(first)
    out: dict = {}
    for row in rows:
        out.setdefault(top(next(iter(row))[0][0]), []).append(row)
    return sorted(out.values(), key=len)


def _fill(share: float):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            held = []
            for row in batch.select(["n_windows", "same", "matches"]).to_pylist():
                least = next(x for x in range(row["n_windows"] + 1) if x / row["n_windows"] >= share)
                held.append(most_held([(m["w"], m["item_slots"], m["slots"]) for m in row["matches"]], max(row["same"], least - 1)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "item_id", "n_windows")), pa.array(held, pa.int64())], names=["doc_id", "item_id", "n_windows", "held"])

    return run


def _candidates(hits: DataFrame, bench: DataFrame, sizes: DataFrame, share: float, n_hits: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, item_id, form) that may reach the share, and the documents' windows by (form, w) (size).

    A document that holds m of an item's n windows holds one of any n - m + 1 of them. The rarest are taken, so a window that many items or documents share joins few rows."""
    often = cut(hits.groupBy("form", "w").agg(F.count(F.lit(1)).alias("size")))
    ranked = bench.select("item_id", "form", "w").distinct().join(often, ["form", "w"], "left").withColumn("size", F.coalesce("size", F.lit(0)))
    place = F.row_number().over(Window.partitionBy("item_id", "form").orderBy("size", "w"))
    first = ranked.withColumn("place", place).join(sizes, ["item_id", "form"]).where(F.col("place") <= F.col("n_windows") - F.ceil(F.col("n_windows") * share - 1e-9) + 1)
    keys = cut(first.where("size > 0").groupBy("form", "w").agg(F.max("size").alias("size"), F.collect_list("item_id").alias("items")))
    met = join_groups(hits.select("doc_id", "form", "w"), keys, ["form", "w"], n_hits)
    return met.select("doc_id", "form", F.explode("items").alias("item_id")).distinct(), often


def contaminated(docs: DataFrame, benchmark: DataFrame, k: int = WORDS, share: float = SHARE, index_windows: int = INDEX_WINDOWS) -> DataFrame:
    """(doc_id, th, item_id, share) of each document (doc_id, text) that holds `share` or more of an item's (item_id, text) distinct template windows with consistent slots, in one of the forms; share is that of the best form, th the hash of the text.

    Slots are consistent where one assignment gives each value of the item one value in the document; the assignment that holds most windows counts, so further occurrences with other values take nothing from a document. An item of fewer than k words is one window of as many words, which a document may hold anywhere. Null and empty texts hold nothing; rows that repeat an id with other texts, and rows without an id, are judged each; empty tables give an empty result. Other columns are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = docs.select(F.struct(F.col("doc_id").cast("long").alias("id"), F.xxhash64(text).alias("th")).alias("doc_id"), text.alias("text"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id IS NOT NULL")
    bench = cut(items.mapInArrow(_hits(k, None, None, "item_id"), f"item_id long, {HITS}").distinct())
    sizes = cut(bench.groupBy("item_id", "form").agg(F.countDistinct("w").alias("n_windows")))
    lengths = sorted({k, *(r.words for r in bench.select("words").distinct().collect())})
    index = None
    known = bench.select("w").distinct()
    if known.count() <= index_windows:
        index = np.sort(known.toArrow().column("w").to_numpy().view(vec.U))
    hits = docs.mapInArrow(_hits(k, index, lengths, "doc_id"), f"doc_id struct<id: long, th: long>, {HITS}").drop("words")
    if index is None:
        hits = hits.join(bench.select("form", "w").distinct(), ["form", "w"], "left_semi")
    hits = cut(hits.distinct())
    n_hits = hits.count()
    candidates, often = _candidates(hits, bench, sizes, share, n_hits)
    theirs = bench.groupBy("item_id", "form", "w").agg(F.collect_set("slots").alias("all_slots")).join(often, ["form", "w"])
    met = cut(hits.join(candidates, ["doc_id", "form"]))
    pairs = cut(join_groups(met, cut(theirs), ["item_id", "form", "w"], n_hits).select("doc_id", "item_id", "form", "w", "slots", F.explode("all_slots").alias("item_slots")))
    # windows held with any values, and with the item's own; only where these differ is an assignment to be searched
    both = cut(pairs.groupBy("doc_id", "item_id", "form").agg(F.countDistinct("w").alias("held"), F.countDistinct(F.when(F.col("slots") == F.col("item_slots"), F.col("w"))).alias("same")).join(sizes, ["item_id", "form"]).where(F.col("held") / F.col("n_windows") >= share))
    plain = both.where("same = held").select("doc_id", "item_id", "n_windows", "held")
    open_pairs = both.where("same < held").select("doc_id", "item_id", "form", "n_windows", "same")
    lists = pairs.join(open_pairs, ["doc_id", "item_id", "form"]).groupBy("doc_id", "item_id", "form", "n_windows", "same").agg(F.collect_list(F.struct("w", "item_slots", "slots")).alias("matches"))
    filled = lists.mapInArrow(_fill(share), "doc_id struct<id: long, th: long>, item_id long, n_windows long, held long")
    out = plain.unionByName(filled).select("doc_id", "item_id", (F.col("held") / F.col("n_windows")).alias("share")).where(F.col("share") >= share)
    return out.groupBy("doc_id", "item_id").agg(F.max("share").alias("share")).select(F.col("doc_id.id").alias("doc_id"), F.col("doc_id.th").alias("th"), "item_id", "share")


def verdicts(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, contaminated, item_ids (sorted), share (of the best item, 0 if none)."""
    found = contaminated(docs, benchmark).groupBy("doc_id", "th").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.round(F.max("share"), 6).alias("share"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("th"))
    same = (F.col("d.th") == F.col("f.th")) & F.col("d.doc_id").eqNullSafe(F.col("f.doc_id"))
    rows = rows.alias("d").join(found.alias("f"), same, "left")
    return rows.select("d.doc_id", F.col("item_ids").isNotNull().alias("contaminated"), F.coalesce("item_ids", F.array().cast("array<long>")).alias("item_ids"), F.coalesce("share", F.lit(0.0)).alias("share"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
