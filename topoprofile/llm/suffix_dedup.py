"""Removal of every byte covered by a long string that starts more than once.

A text is its UTF-8 bytes; matches stay inside a text. Any ``LENGTH``-byte string
has a least ``GRAM``-byte hash among its grams (its key), and equal strings have
equal keys. So each text is cut into runs of window starts that share a key, and

1. keys are counted over all texts (combined before the shuffle); runs whose key
   occurs once cannot repeat and are dropped;
2. equal runs (same key and content) are counted: all windows of a content that
   occurs twice repeat, without any comparison;
3. keys with several contents go to shards by key, one string per content. A
   shard builds its suffix array by Larsson-Sadakane refinement (groups of equal
   prefix, doubled and re-sorted until single), takes common prefixes by Kasai's
   bound, and reports windows whose neighbour shares ``LENGTH`` bytes;
4. a key with over ``STRINGS`` contents is cut into slices with a suffix array
   each, and each pair of slices is merged by binary search of one's windows in
   the other's array. No shard grows with a key.

Each step is exact, runs over all texts, and costs time in proportion to them:
no shard is compared with shards that hold other keys.

Defined cases. Null text: empty. Texts shorter than ``LENGTH``: nothing to
remove. Repeated rows and equal texts are each other's repeats. Null ids are
kept. Empty table: no rows. Texts of any length are read whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topoprofile.llm.files import small_batches
from topoprofile.llm.joins import join_lookup
from topoprofile.runtime import materialize

LENGTH = 200
#: Bytes of a gram, a multiple of 8: longer ones recur less by chance, shorter ones make longer runs.
GRAM = 40
#: Bytes of texts whose keys are found at once, and of strings in one suffix array.
BUFFER = 2_000_000
SHARD = 1_500_000
#: Contents of one key that a shard takes (each under 2 * LENGTH bytes).
STRINGS = 4_000
#: Bits of a place in packed sort keys: a shard has under 2**21 bytes.
PLACE_BITS = 21
#: Window starts in a run: as many as one gram stays inside.
RUN = LENGTH - GRAM + 1
#: Lane length of the common-prefix scan.
LANE = 64


def _words(data: np.ndarray) -> np.ndarray:
    """The big-endian 8-byte number at each offset (zeros behind the end)."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 8)[: len(data)]).view(">u8").ravel().astype(np.uint64)


def _sliding(values: np.ndarray, width: int, least) -> np.ndarray:
    """Running minimum (or maximum) over ``width`` values, from block prefixes and suffixes."""
    n = len(values) - width + 1
    fill = np.full(-len(values) % width, values[-1], values.dtype)
    blocks = np.concatenate([values, fill]).reshape(-1, width)
    prefix = least.accumulate(blocks, axis=1).ravel()
    suffix = least.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return least(suffix[:n], prefix[width - 1 : width - 1 + n])


def window_runs(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Runs of window starts with one key: text number, start, windows, key, and whether the key recurs in its text."""
    empty = tuple(np.empty(0, k) for k in (np.int64, np.int32, np.int32, np.int64, np.int32))
    sizes = np.array([len(t) for t in texts], np.int64)
    if not len(sizes) or sizes.max() < LENGTH:
        return empty
    data = np.frombuffer(b"".join(texts), np.uint8)
    words = _words(data)
    count = len(data) - GRAM + 1
    grams = np.zeros(count, np.uint64)
    for at in range(0, GRAM, 8):  # mixed word by word
        grams += words[at : at + count]
        grams *= np.uint64(0x9E3779B97F4A7C15)
        grams ^= grams >> np.uint64(29)
    grams *= np.uint64(0xBF58476D1CE4E5B9)
    grams ^= grams >> np.uint64(32)
    keys = _sliding(grams, RUN, np.minimum)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    long = sizes >= LENGTH
    # windows that lie inside one text
    mark = np.zeros(len(keys) + 1, np.int8)
    mark[begins[long]] += 1
    np.subtract.at(mark, ends[long] - LENGTH + 1, 1)
    inside = np.cumsum(mark[:-1]).astype(bool)
    first = np.r_[True, (keys[1:] != keys[:-1]) | (inside[1:] != inside[:-1])]
    first[begins[long]] = True
    heads = np.flatnonzero(first)
    counts = np.diff(np.r_[heads, len(keys)])
    heads, counts = heads[inside[heads]], counts[inside[heads]]
    # runs longer than one gram lasts are cut
    pieces = -(-counts // RUN)
    nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    starts = np.repeat(heads, pieces) + nth * RUN
    counts = np.minimum(np.repeat(counts, pieces) - nth * RUN, RUN)
    number = np.searchsorted(ends, starts, side="right")
    key = keys[starts]
    # grams that are some window's least one; a value at two places of a text may lie twice in one run
    reach = np.concatenate([np.zeros(RUN - 1, np.uint64), keys, np.zeros(RUN - 1, np.uint64)])
    chosen = np.flatnonzero(_sliding(reach, RUN, np.maximum)[: len(grams)] == grams)
    order = np.lexsort((chosen, grams[chosen]))
    value, place = grams[chosen][order], chosen[order]
    near = (value[1:] == value[:-1]) & (place[1:] - place[:-1] < 2 * LENGTH)
    again = np.isin(key, value[1:][near])
    return number, (starts - begins[number]).astype(np.int32), counts.astype(np.int32), key.view(np.int64), again.astype(np.int32)


def _by_keys(keys: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys (under 2**43) and places in key order, equal keys by place: one plain sort of packed numbers where they fit."""
    if len(places) and int(places.max()) >= 1 << PLACE_BITS:
        order = np.lexsort((places, keys))
        return keys[order], places[order]
    packed = np.sort(keys << np.uint64(PLACE_BITS) | places.astype(np.uint64))
    return packed >> np.uint64(PLACE_BITS), (packed & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int32)


def suffix_array(words: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Positions in suffix order; a suffix stops at its string's ``end``, equal ones stay in order of position.

    Larsson-Sadakane: ranks are group heads in the order so far; only groups of
    several members are sorted again, by the rank of what follows.
    """
    n, depth = len(words), 5
    left = end - np.arange(n, dtype=end.dtype)
    # five bytes, those behind the end as zeros, and how many there are: a zero byte is no end
    size = np.minimum(left, depth).astype(np.uint64)
    key = words >> (np.uint64(8) * (np.uint64(8) - size)) << (np.uint64(8) * (np.uint64(depth) - size)) << np.uint64(3) | size
    key, members = _by_keys(key, np.arange(n, dtype=np.int32))
    begin = np.r_[n > 0, key[1:] != key[:-1]]
    rank = np.empty(n, np.int32)
    rank[members] = np.maximum.accumulate(np.where(begin, np.arange(n, dtype=np.int32), 0)) if n else 0
    members = members[np.r_[~begin[1:], False] | ~begin]
    while len(members := members[left[members] >= depth]):
        follow = np.where(left[members] > depth, rank[np.minimum(members + depth, n - 1)] + 1, 0)
        key = rank[members].astype(np.uint64) << np.uint64(22) | follow.astype(np.uint64)
        if n >= 1 << 21:  # the packed key does not hold both ranks
            order = np.lexsort((members, follow, rank[members]))
            members, key = members[order], np.cumsum(np.r_[0, np.any(np.diff(np.stack([rank[members], follow])[:, order], axis=1), axis=0)])
            own = rank[members]
        else:
            key, members = _by_keys(key, members)
            own = key >> np.uint64(22)
        begin = np.r_[True, key[1:] != key[:-1]]
        group = np.r_[True, own[1:] != own[:-1]]
        at = np.arange(len(key), dtype=np.int32)
        offset = np.maximum.accumulate(np.where(begin, at, 0)) - np.maximum.accumulate(np.where(group, at, 0))
        rank[members] += offset
        members, depth = members[np.r_[~begin[1:], False] | ~begin], depth * 2
    return _by_keys(rank.astype(np.uint64), np.arange(n, dtype=np.int32))[1]


_BYTES = np.array([1 << (8 * k) for k in range(8)], np.uint64)


def common_prefixes(words: np.ndarray, end: np.ndarray, order: np.ndarray, most: int = LENGTH) -> np.ndarray:
    """For each place in ``order`` the bytes shared with the one before, up to ``most``.

    Kasai: the suffix one byte on shares one byte less at least, so a scan in
    text order only looks at what is new. Lanes of the text are scanned together.
    """
    n = len(order)
    before = np.full(n, -1, np.int32)
    before[order[1:]] = order[:-1]
    limit = np.minimum(end - np.arange(n, dtype=np.int32), most)
    limit = np.where(before >= 0, np.minimum(limit, end[before] - before), 0)
    shared = np.zeros(n, np.int32)
    lanes = np.arange(0, n, LANE)
    held = np.zeros(len(lanes), np.int32)
    for t in range(LANE):
        at = lanes[lanes + t < n] + t
        held = np.minimum(np.maximum(held[: len(at)] - 1, 0), limit[at])
        live = np.flatnonzero(held < limit[at])
        while len(live):
            i = at[live]
            differ = words[i + held[live]] ^ words[before[i] + held[live]]
            held[live] = np.minimum(held[live] + 8 - np.searchsorted(_BYTES, differ, side="right").astype(np.int32), limit[i])
            live = live[(differ == 0) & (held[live] < limit[i])]
        shared[at] = held
    return shared[order]


class Shard:
    """The suffix array of some strings, and which of their windows repeat among them."""

    def __init__(self, strings: list[bytes]):
        self.sizes = np.array([len(s) for s in strings], np.int64)
        data = np.frombuffer(b"".join(strings), np.uint8)
        self.ends = np.cumsum(self.sizes)
        self.end = np.repeat(self.ends, self.sizes).astype(np.int32)
        self.words = _words(data)
        self.order = suffix_array(self.words, self.end)
        shared = common_prefixes(self.words, self.end, self.order)
        whole = np.r_[shared >= LENGTH, False]
        self.repeats = np.zeros(len(data), bool)
        self.repeats[self.order] = whole[:-1] | whole[1:]
        self.windows = self.order[self.end[self.order] - self.order >= LENGTH]

    def _compare(self, places: np.ndarray, other: Shard, others: np.ndarray) -> np.ndarray:
        """Sign of own window against the other's, by their ``LENGTH`` bytes."""
        out = np.zeros(len(places), np.int8)
        live = np.arange(len(places))
        for k in range(0, LENGTH, 8):  # LENGTH is a multiple of 8
            a, b = self.words[places[live] + k], other.words[others[live] + k]
            differ = a != b
            out[live[differ]] = np.where(a[differ] < b[differ], -1, 1)
            live = live[~differ]
            if not len(live):
                break
        return out

    def merge(self, other: Shard) -> None:
        """Mark the windows that both shards hold: binary search of own windows in the other's array."""
        if not len(self.windows) or not len(other.windows):
            return
        low = np.zeros(len(self.windows), np.int64)
        high = np.full(len(self.windows), len(other.windows), np.int64)
        while len(live := np.flatnonzero(low < high)):
            middle = (low[live] + high[live]) // 2
            sign = self._compare(self.windows[live], other, other.windows[middle])
            low[live] = np.where(sign > 0, middle + 1, low[live])
            high[live] = np.where(sign > 0, high[live], middle)
        there = np.flatnonzero(low < len(other.windows))
        there = there[self._compare(self.windows[there], other, other.windows[low[there]]) == 0]
        self.repeats[self.windows[there]] = True
        # the other's equal windows follow each other in its array
        equal = np.zeros(len(other.windows), bool)
        at = np.unique(low[there])
        while len(at):
            equal[at] = True
            step = at[at + 1 < len(other.windows)]
            step = step[other._compare(other.windows[step], other, other.windows[step + 1]) == 0] + 1
            at = step[~equal[step]]
        other.repeats[other.windows[equal]] = True

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """String number, first and end of each run of repeated window starts, inside the string."""
        edge = np.diff(np.r_[False, self.repeats, False].astype(np.int8))
        first, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        number = np.searchsorted(self.ends, first, side="right")
        base = (self.ends - self.sizes)[number]
        return number, first - base, stop - base


def _text_id():
    return F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary")))


def _find_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["key", "content", "tid", "start", "windows", "again"]

    def found(tids: list[bytes], texts: list[bytes]) -> pa.RecordBatch:
        number, start, windows, key, again = window_runs(texts)
        digest = xxhash.xxh64_intdigest
        content = (digest(texts[t][s : s + n + LENGTH - 1], 1) for t, s, n in zip(number.tolist(), start.tolist(), windows.tolist(), strict=True))
        content = np.fromiter(content, np.uint64, len(number)).view(np.int64)
        tid = pa.array([tids[t] for t in number.tolist()], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(content), tid, pa.array(start), pa.array(windows), pa.array(again)], names=names)

    for batch in batches:
        tids, texts, held = [], [], 0
        for tid, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            raw = text.as_buffer().to_pybytes()
            if len(raw) < LENGTH:
                continue
            tids.append(tid)
            texts.append(raw)
            held += len(raw)
            if held >= BUFFER:
                yield found(tids, texts)
                tids, texts, held = [], [], 0
        if texts:
            yield found(tids, texts)


_RUNS = "key long, content long, tid binary, start int, windows int, again int"


def _cut_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for text, cuts in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            raw = text.as_buffer().to_pybytes()
            for at in range(0, len(cuts), 5_000):
                part = cuts[at : at + 5_000]
                columns = [[c[k] for c in part] for k in ("key", "content", "tid", "start", "settled")]
                strings = pa.array([raw[c["start"] : c["start"] + c["windows"] + LENGTH - 1] for c in part], pa.binary())
                arrays = [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary()), pa.array(columns[3], pa.int32()), pa.array(columns[4], pa.bool_()), strings]
                yield pa.RecordBatch.from_arrays(arrays, names=["key", "content", "tid", "start", "settled", "string"])


_SPANS = "tid binary, first int, stop int"


def _search_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by task (key, lo, hi): small tasks share a suffix array, a pair of slices has two."""

    def spans(rows: list[tuple], shard: Shard) -> pa.RecordBatch:
        number, first, stop = shard.runs()
        keep = [k for k, n in enumerate(number.tolist()) if not rows[n][3]]
        number, first, stop = number[keep], first[keep], stop[keep]
        start = np.array([rows[n][2] for n in number.tolist()], np.int64)
        tid = pa.array([rows[n][1] for n in number.tolist()], pa.binary())
        return pa.RecordBatch.from_arrays([tid, pa.array((start + first).astype(np.int32)), pa.array((start + stop).astype(np.int32))], names=["tid", "first", "stop"])

    def finish(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        if held:
            yield spans(held, Shard([r[4] for r in held]))

    def pair(task: tuple, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        halves = [[r for r in rows if r[5] == side] for side in task[1:]]
        if all(halves):
            a, b = (Shard([r[4] for r in half]) for half in halves)
            a.merge(b)
            yield spans(halves[0], a)
            yield spans(halves[1], b)
        else:
            yield from finish(halves[0] or halves[1])

    held, size, task, sliced = [], 0, None, []
    for batch in batches:
        for key, lo, hi, slice_, tid, start, settled, string in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (key, lo, hi) != task:
                if sliced:
                    yield from pair(task, sliced)
                    sliced = []
                if size >= SHARD:
                    yield from finish(held)
                    held, size = [], 0
                task = (key, lo, hi)
            row = (key, tid, start, settled, string, slice_)
            if lo < hi:
                sliced.append(row)
            else:
                held.append(row)
                size += len(string)
    if sliced:
        yield from pair(task, sliced)
    yield from finish(held)


def repeated_spans(docs: DataFrame, strings: int = STRINGS) -> DataFrame:
    """``tid, spans``: for each text id with repeats its merged byte intervals (first, stop), in order."""
    small_batches(docs.sparkSession)
    texts = docs.select(_text_id().alias("tid"), F.coalesce("text", F.lit("")).alias("text"), "doc_id")
    runs = materialize(texts.select("tid", F.col("text").cast("binary").alias("text")).mapInArrow(_find_runs, _RUNS), "runs")
    keys = runs.groupBy("key").agg(F.sum(F.col("again") + 1).alias("places")).where("places > 1").select("key")
    # equal texts hand in equal rows: combined here
    shared = runs.join(keys, "key", "left_semi").groupBy("key", "content", "tid", "start", "windows").agg(F.count("*").alias("times"), F.max("again").alias("again"))
    shared = materialize(shared, "shared")
    contents = shared.groupBy("key", "content").agg(F.sum("times").alias("times"), F.max("again").alias("again"), F.min(F.struct("tid", "start", "windows")).alias("one"), F.count("*").alias("count"))
    contents = materialize(contents, "contents")
    per_key = contents.groupBy("key").agg(F.count("*").alias("strings"), F.min("times").alias("least"), F.max("again").alias("again"))
    # a search is needed where some content occurs once, and may share windows with others or with itself
    open_keys = per_key.where("least = 1 AND (strings > 1 OR again > 0)").select("key", F.ceil(F.col("strings") / strings).cast("int").alias("slices"))
    open_keys = materialize(open_keys, "keys")
    searched = contents.join(open_keys.select("key"), "key", "left_semi")
    cuts = searched.select("one.tid", F.struct("key", "content", "one.tid", "one.start", "one.windows", (F.col("times") > 1).alias("settled")).alias("cut"))
    cuts = cuts.groupBy("tid").agg(F.collect_list("cut").alias("cuts"))  # as many as the text has runs
    firsts = texts.groupBy("tid").agg(F.min("doc_id").alias("doc_id"))
    wanted = materialize(cuts.join(firsts, "tid"), "wanted")
    fetched = texts.join(wanted, (texts["tid"] == wanted["tid"]) & texts["doc_id"].eqNullSafe(wanted["doc_id"]))
    pieces = fetched.select(F.col("text").cast("binary").alias("text"), "cuts").mapInArrow(_cut_strings, "key long, content long, tid binary, start int, settled boolean, string binary")
    # rows that repeat an id and a text were cut twice: within a shard that would look like a repeat
    pieces = pieces.groupBy("key", "content").agg(F.first(F.struct("tid", "start", "settled", "string")).alias("p")) if _repeats_rows(docs) else pieces.select("key", "content", F.struct("tid", "start", "settled", "string").alias("p"))
    hot = open_keys.where("slices > 1")
    dealt = pieces.join(hot, "key", "left") if not hot.isEmpty() else pieces.withColumn("slices", F.lit(1))
    dealt = dealt.withColumn("slices", F.coalesce("slices", F.lit(1))).withColumn("slice", F.pmod(F.xxhash64("content"), F.col("slices")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.expr("sequence(0, slices - 1)"))).where("slices = 1 OR other != slice")
    dealt = dealt.select("key", F.least("slice", "other").alias("lo"), F.greatest("slice", "other").alias("hi"), "slice", "p.*")
    dealt = dealt.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "tid", "start")
    found = dealt.mapInArrow(_search_shards, _SPANS)
    # contents that occur twice repeat as a whole, in every place
    twice = contents.where("times > 1").select(F.struct("key", "content").alias("kc"), F.lit(True).alias("twice"), "count")
    placed = shared.select(F.struct("key", "content").alias("kc"), "tid", F.col("start").alias("first"), (F.col("start") + F.col("windows")).alias("stop"))
    placed = join_lookup(placed, twice.select("kc", "twice"), "kc", twice.select("kc", "count"), shared.count()).where("twice").select("tid", "first", "stop")
    starts = found.unionByName(placed)
    merged = """aggregate(array_sort(collect_list(struct(first, stop + {n} AS stop))), cast(array() AS array<struct<first:int,stop:int>>),
        (a, x) -> CASE WHEN size(a) > 0 AND x.first <= element_at(a, -1).stop
                       THEN concat(slice(a, 1, size(a) - 1), array(named_struct('first', element_at(a, -1).first, 'stop', greatest(element_at(a, -1).stop, x.stop))))
                       ELSE array_append(a, x) END)""".format(n=LENGTH - 1)
    return materialize(starts.groupBy("tid").agg(F.expr(merged).alias("spans")), "spans")


def _repeats_rows(docs: DataFrame) -> bool:
    counted = docs.groupBy("doc_id", _text_id()).count()
    return not counted.where("count > 1").isEmpty()


def with_spans(docs: DataFrame, strings: int = STRINGS) -> DataFrame:
    """``docs`` with ``spans``: the byte intervals to remove, null where there are none."""
    spans = repeated_spans(docs, strings)
    docs = docs.drop("spans")
    named = docs.select(F.struct(*docs.columns).alias("_row"), _text_id().alias("tid"))
    counts = named.groupBy("tid").count()
    return join_lookup(named, spans, "tid", counts, docs.count()).select("_row.*", "spans")


def without(raw: bytes, spans: list) -> bytes:
    """The bytes outside the intervals."""
    kept, at = [], 0
    for span in spans:
        kept.append(raw[at : span["first"]])
        at = span["stop"]
    kept.append(raw[at:])
    return b"".join(kept)


def remove_repeats(docs: DataFrame, strings: int = STRINGS) -> DataFrame:
    """``docs`` with ``kept``, the remaining bytes of each text."""

    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([without((t or "").encode("utf-8"), [] if s is None else s) for t, s in zip(texts, spans, strict=True)])

    return with_spans(docs, strings).withColumn("kept", F.pandas_udf(cut, "binary")("text", "spans")).drop("spans")


def op6_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """What is removed of every whole document, and the digest of the rest."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    spans = with_spans(docs)

    def digest(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else hashlib.sha256(without(t.encode("utf-8"), s)).hexdigest() for t, s in zip(texts, spans, strict=True)], dtype=object)

    text = F.coalesce("text", F.lit(""))
    # only texts with spans go to Python
    cut = F.pandas_udf(digest, "string")(F.when(F.col("spans").isNotNull(), text), "spans")
    removed = F.expr("aggregate(spans, 0L, (a, x) -> a + (x.stop - x.first))")
    return spans.select(
        "doc_id",
        F.octet_length(text).cast("long").alias("n_bytes"),
        F.coalesce(removed, F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce(F.when(F.col("spans").isNotNull(), F.size("spans")), F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce(cut, F.sha2(text, 256)).alias("kept_sha256"),
    )
