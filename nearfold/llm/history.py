"""New batches against everything accepted before, without working through that history again.

The history is a store below the shared folder. Every batch that is taken in adds tables of its own:
full hashes in buckets by their hash, and signatures (fingerprints with their duration, smallest ord
and labels) in buckets by duration band and hash. Later batches open the files of the buckets that
their own keys fall into: the bucket of a hash, the buckets of the duration bands a video may agree
with. Nothing of the history is shuffled, joined or read through Spark again. The task of a bucket
indexes it against the batch by combinations of tokens (see combinations.py), which misses no alike
pair, and verifies what meets there and then; only (unit, smallest alike ord) leaves it.

A batch becomes part of the history by its manifest, written last and moved into place: a failed
batch leaves no trace, and taking it in again writes over what it left. Manifests list the live
parts; ``History.open`` reads the newest. After MOST_PARTS batches parts are merged into one.

Within a batch rows count in the order of ord: a row is refused if an accepted row before it repeats
it. Rows with the same hash, fingerprint and duration are one unit. Units that repeat nothing in the
history are decided in one task, at most STEP_ROWS rows of a batch at a time, in chunks that grow: a
chunk meets what was accepted before it and itself, so a large group of alike newcomers is never
compared pair by pair.

Defined results: rows with neither a hash nor a usable fingerprint are accepted; null, NaN and
non-positive durations and fingerprints of another version or with null words are not usable; an
empty history or batch is fine; of rows with the same ord one is taken; other columns are ignored.
"""

from __future__ import annotations

import itertools
import json
import math
import posixpath
import uuid
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.similarity import DURATION_DELTA, DURATION_RATIO, flat
from ..runtime import parts_for, ship_package, stage, staged_path, unstage
from .alikeness import VIDEO
from ..operators.combinations import HELD, Index, close_items, crossing_family, crossing_words, family, frequent_words
from .fingerprints import usable, with_class_key
from .hotpairs import alike_rows, combined, near_words

#: Words of signatures, and hashes, that one bucket should hold, about.
WORDS_PER_BUCKET, HASHES_PER_BUCKET = 1 << 20, 1 << 21
#: Rows of a batch that are decided in one step, and units of the first chunk of a step.
STEP_ROWS, FIRST_CHUNK = 200_000, 128
#: Words of either side, of buckets and of a batch, that one task compares, about.
WORDS_PER_SIDE = 1 << 21
#: Live parts of a history before they are merged.
MOST_PARTS = 16
#: Durations of one band differ by this factor at most: compatible ones lie in the same or the next band.
BAND = math.log(DURATION_RATIO * (1 + 1e-9))

SIGNATURE = "h1 long, h2 long, ord long, duration double, words array<long>, labels array<long>"


def _system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri("file:///" + path[5:].lstrip("/") if path.startswith("file:") else path)


def _opened(path: str, columns: list[str]) -> pa.Table | None:
    """The Parquet files of one folder."""
    system, root = _system(path)
    found = system.get_file_info(fs.FileSelector(root, allow_not_found=True))
    files = sorted(i.path for i in found if i.path.endswith(".parquet"))
    tables = [pq.ParquetFile(system.open_input_file(f)).read(columns=columns) for f in files]
    return pa.concat_tables(tables).combine_chunks() if tables else None


def _compatible(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    low, high = np.minimum(a, b), np.maximum(a, b)
    return (low > 0) & (high / np.where(low > 0, low, 1) <= DURATION_RATIO) & (high - low <= DURATION_DELTA)


def _ragged(tables: list[pa.Table]) -> tuple[np.ndarray, np.ndarray]:
    lists = pa.chunked_array([c for t in tables for c in t.column("words").chunks], pa.list_(pa.int64())).combine_chunks()
    values, offsets = flat(lists)
    return values[offsets[0] : offsets[-1]], offsets - offsets[0]


def _sided(index: Index, values: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> dict[tuple[int, bool], tuple[np.ndarray, np.ndarray]]:
    """Words and rows of the entries of some rows by key and freshness, made from a part of the rows at a time."""
    out: dict[tuple[int, bool], list[tuple[np.ndarray, np.ndarray]]] = defaultdict(list)
    for part in np.array_split(rows, max(1, len(rows) >> 14)):
        got = index.entries(*_kept(values, offsets, part))
        group = 2 * got.key + (1 if got.fresh is None else got.fresh)
        order = np.argsort(group, kind="stable")
        for some in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
            if len(some):
                number = int(group[some[0]])
                out[number >> 1, bool(number & 1)].append((got.word[some], part[got.row[some]].astype(np.int32)))
    return {k: tuple(np.concatenate(x) for x in zip(*out.pop(k))) for k in list(out)}


def _crossing(index: Index, values: np.ndarray, offsets: np.ndarray, sides: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Distinct pairs of a row of either side that hold entries of one key within the distance of an index."""
    left, right = (_sided(index, values, offsets, rows) for rows in sides)
    held, size = [np.zeros(0, np.int64)], 0
    for (key, fresh), (a, x) in left.items():
        for (b, y) in (right[key, f] for f in (False, True) if (fresh or f) and (key, f) in right):
            for i, j in crossing_words(a, b, crossing_family(len(a), len(b), index.bits, index.most), index.most):
                held.append(x[i].astype(np.int64) << 32 | y[j])
                size += len(i)
                if size > HELD:
                    held = [np.unique(np.concatenate(held))]
                    size = len(held[0]) // 2
    codes = np.unique(np.concatenate(held))
    return np.stack([codes >> 32, codes & 0xFFFFFFFF], 1)


def alike_across(tables: tuple[pa.Table, pa.Table], hot: np.ndarray, *, inside: bool = False) -> np.ndarray:
    """Alike pairs (row of the first table, row of the second) of two tables of distinct fingerprints (words, labels).

    With ``inside`` pairs of two rows of the first table as well, its rows counted on in the second column.
    """
    m = tables[0].num_rows
    values, offsets = _ragged(list(tables))
    sizes = np.diff(offsets)
    labels = [x or () for t in tables for x in t.column("labels").to_pylist()]
    touched = np.array([bool(x) for x in labels], bool)
    first = np.arange(len(sizes)) < m
    held: list[np.ndarray] = []

    def search(rows: np.ndarray, after: bool) -> None:
        kinds, counts = np.unique(sizes[rows], return_counts=True)
        for index in VIDEO.indexes(dict(zip(kinds.tolist(), counts.tolist())), hot, after):
            if not inside:
                held.append(_crossing(index, values, offsets, (rows[first[rows]], rows[~first[rows]])))
                continue
            got = index.entries(*_kept(values, offsets, rows))
            masks = list(family(index.words // index.keys or 1, index.bits, index.most))
            order = np.argsort(got.key, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(got.key[order])) + 1):
                if not len(part):
                    continue
                item = rows[got.row[part]]
                fresh = first[item] if got.fresh is None else got.fresh[part]
                for pairs in close_items(got.word[part], item, masks, index.most, fresh=fresh):
                    held.append(pairs[first[pairs[:, 0]]])

    search(np.arange(len(sizes)), False)
    both = np.flatnonzero(touched)
    if first[both].any():
        search(both, True)
    pairs = np.unique(np.concatenate([np.zeros((0, 2), np.int64), *held]), axis=0)
    held.clear()
    out = []
    for part in np.array_split(pairs, max(1, len(pairs) >> 17)):
        out.append(part[VIDEO.alike(*_kept(values, offsets, part[:, 0]), *_kept(values, offsets, part[:, 1]), VIDEO.least)])
    own = np.array([VIDEO.lost(n) + 1 for n in sizes.tolist()], np.int64)
    groups: dict[int, list[int]] = defaultdict(list)
    for size in set(own[both].tolist()):
        for i in both.tolist():
            if size <= min(int(own[i]), len(labels[i])):
                for number in combined(list(labels[i]), size):
                    groups[number].append(i)
        for rows in (np.array(r) for r in groups.values() if len(r) > 1):
            if (own[rows] == size).any() and first[rows].any():
                x, y = alike_rows(values, offsets, rows, rows, np.arange(len(sizes)), own == size, VIDEO.alike, VIDEO.least, VIDEO.likely, first)
                out.append(np.stack([np.minimum(x, y), np.maximum(x, y)], 1))
        groups.clear()
    pairs = np.unique(np.concatenate(out), axis=0)
    return pairs if inside else pairs[~first[pairs[:, 1]]] - [0, m]


def _kept(values: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.diff(offsets)[rows]
    ends = np.concatenate([[0], np.cumsum(sizes)])
    return values[np.arange(ends[-1]) + np.repeat(offsets[rows] - ends[:-1], sizes)], ends


def _classes(table: pa.Table) -> tuple[pa.Table, np.ndarray]:
    """The distinct fingerprints of a table of signatures, and the one of each row."""
    keys = np.stack([table.column(c).to_numpy() for c in ("h1", "h2")], 1)
    _, first, back = np.unique(keys, axis=0, return_index=True, return_inverse=True)
    return table.select(["words", "labels"]).take(pa.array(first)), back.ravel()


def _rows_of(classes: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows in the order of their class, and where each class begins."""
    return np.argsort(classes, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(classes, minlength=count))])


def smallest_alike(probes: pa.Table, stored: pa.Table, hot: np.ndarray) -> np.ndarray:
    """For each probe the smallest ord of an alike stored signature of compatible duration; -1 where there is none."""
    (new, new_of), (old, old_of) = _classes(probes), _classes(stored)
    pairs = alike_across((new, old), hot)
    asked, asked_at = _rows_of(new_of, new.num_rows)
    kept, kept_at = _rows_of(old_of, old.num_rows)
    a, b = np.diff(asked_at)[pairs[:, 0]], np.diff(kept_at)[pairs[:, 1]]
    durations = probes.column("duration").to_numpy(), stored.column("duration").to_numpy()
    ords = stored.column("ord").to_numpy()
    none = np.iinfo(np.int64).max
    best = np.full(probes.num_rows, none)
    for part in np.array_split(np.arange(len(pairs)), max(1, int((a * b).sum()) >> 22)):
        count = (a * b)[part]
        which = np.repeat(part, count)
        step = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
        x = asked[asked_at[pairs[which, 0]] + step // np.maximum(b[which], 1)]
        y = kept[kept_at[pairs[which, 1]] + step % np.maximum(b[which], 1)]
        fits = _compatible(durations[0][x], durations[1][y])
        np.minimum.at(best, x[fits], ords[y[fits]])
    return np.where(best == none, -1, best)


def _joined(folders: list[str], columns: list[str]) -> pa.Table | None:
    tables = [t for f in folders if (t := _opened(f, columns)) is not None and t.num_rows]
    return pa.concat_tables(tables).combine_chunks() if tables else None


def _fitting(asked: pa.Table, stored: pa.Table) -> pa.Table:
    """Rows of a duration that some stored row may agree with."""
    spans, duration = stored.column("duration").to_numpy(), asked.column("duration").to_numpy()
    return asked.filter(pa.array(_compatible(duration, np.clip(duration, spans.min(), spans.max()))))


def _probed(tiles: list[tuple[list[str], list[str]]], hot: np.ndarray):
    """Numbers of tiles (folders of stored signatures, folders of probes) to (h1, h2, duration, seen)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number in batch.column(0).to_pylist():
                folders, probes = tiles[number]
                columns = ["h1", "h2", "duration", "words", "labels"]
                if (asked := _joined(probes, columns)) is None or (stored := _joined(folders, [*columns, "ord"])) is None:
                    continue
                asked = _fitting(asked, stored)
                seen = smallest_alike(asked, stored, hot)
                some = asked.select(["h1", "h2", "duration"]).append_column("seen", pa.array(seen)).filter(pa.array(seen >= 0))
                yield from some.combine_chunks().to_batches()

    return run


def _known(folders: list[str]):
    """Hashes (bucket, unit, full_hash) found in a bucket's files: (unit, seen)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stored: dict[int, pa.Table | None] = {}
        for batch in batches:
            for bucket in set(batch.column("bucket").to_pylist()):
                if bucket not in stored:
                    stored[bucket] = _opened(folders[bucket], ["full_hash", "ord"])
                if (table := stored[bucket]) is None:
                    continue
                some = batch.filter(pc.equal(batch.column("bucket"), bucket))
                at = pc.index_in(some.column("full_hash"), value_set=table.column("full_hash").combine_chunks())
                hit = pc.is_valid(at)
                if pc.any(hit).as_py():
                    yield pa.RecordBatch.from_arrays([some.column("unit").filter(hit), table.column("ord").take(at.filter(hit)).combine_chunks()], ["unit", "seen"])

    return run


def _labels(hot: np.ndarray):
    """Fills in the labels of batches of signatures: numbers of the frequent words that their words are near to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, offsets = flat(batch.column("words"))
            at, which = near_words(values[offsets[0] : offsets[-1]], hot, VIDEO.reach, VIDEO.bits)
            item = np.repeat(np.arange(batch.num_rows), np.diff(offsets))[at]
            order = np.lexsort((which, item))
            ends = np.concatenate([[0], np.cumsum(np.bincount(item, minlength=batch.num_rows))])
            labels = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(which[order].astype(np.int64)))
            yield batch.set_column(batch.schema.get_field_index("labels"), "labels", labels)

    return run


DECIDED = "unit long, near long, accepted boolean"


def _decided(hot: np.ndarray, first_chunk: int):
    """Open units (unit, full_hash, h1, h2, duration, words, labels) in the order of ord to what they repeat among themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        table = pa.Table.from_batches(got).combine_chunks().sort_by("unit").combine_chunks()
        units, hashes = table.column("unit").to_numpy(), table.column("full_hash").to_pylist()
        with_words = np.flatnonzero(pc.is_valid(table.column("words")).to_numpy())
        classes, of = _classes(table.take(pa.array(with_words)))
        cls = np.full(len(units), -1)
        cls[with_words] = of
        durations = table.column("duration").to_numpy()
        taken: set[str] = set()
        standing: dict[int, list[int]] = defaultdict(list)  # accepted units by class
        alike: dict[int, list[int]] = defaultdict(list)
        accepted, near = np.zeros(len(units), bool), np.full(len(units), -1)
        done, size = 0, first_chunk
        while done < len(units):
            chunk = np.arange(done, min(len(units), done + size))
            fresh = np.unique(cls[chunk][cls[chunk] >= 0])
            before = np.setdiff1d(np.array([c for c in standing if standing[c]], np.int64), fresh)
            # classes alike to one accepted before are settled without being compared with each other, unless durations part them
            ahead = {c: [c] for c in fresh.tolist()}
            old = np.union1d(before, np.array([c for c in fresh.tolist() if standing.get(c)], np.int64))
            for x, y in alike_across((classes.take(pa.array(fresh)), classes.take(pa.array(old))), hot).tolist() if len(old) else ():
                ahead[int(fresh[x])].append(int(old[y]))

            def repeated(i: int, known: list[int]) -> int:
                some = [u for c in known for u in standing.get(c, ())]
                fits = [u for u in some if _compatible(durations[u], durations[i])]
                return int(min((units[u] for u in fits), default=-1))

            open_ = []
            for i in chunk.tolist():
                if cls[i] < 0 or (seen := repeated(i, ahead[int(cls[i])])) < 0:
                    open_.append(i)
                elif hashes[i] is None or hashes[i] not in taken:
                    near[i] = seen
            rest = np.unique([cls[i] for i in open_ if cls[i] >= 0]).astype(np.int64)
            alike.clear()
            if len(rest) > 1:
                some = classes.take(pa.array(rest))
                for x, y in alike_across((some, some.slice(0, 0)), hot, inside=True).tolist():
                    alike[int(rest[x])].append(int(rest[y]))
                    alike[int(rest[y])].append(int(rest[x]))
            for i in open_:
                if hashes[i] is not None and hashes[i] in taken:
                    continue
                c = int(cls[i])
                # what was accepted before this chunk has been looked at
                if c >= 0 and (seen := repeated(i, [c, *alike[c]])) >= 0:
                    near[i] = seen
                    continue
                accepted[i] = True
                if hashes[i] is not None:
                    taken.add(hashes[i])
                if c >= 0:
                    standing[c].append(i)
            done += len(chunk)
            size *= 2
        yield pa.RecordBatch.from_arrays([pa.array(units), pa.array(near, mask=near < 0), pa.array(accepted)], ["unit", "near", "accepted"])

    return run


@dataclass(frozen=True)
class Found:
    """What a search of some parts of a history found for many rows at once: ``full_hash, before`` and ``h1, h2, duration, older`` (staged)."""

    parts: frozenset[int]
    hashes: DataFrame
    signatures: DataFrame


class History:
    """Accepted rows of one collection, kept in ``path`` below the shared folder."""

    def __init__(self, spark: SparkSession, path: str, state: dict):
        self.spark, self.path, self.state = spark, path, state
        self.hot = np.array(state["frequent"], dtype=np.uint64)
        ship_package(spark)

    @classmethod
    def create(cls, rows: DataFrame, path: str | None = None) -> History:
        """A history in which all of ``rows`` are accepted."""
        spark = rows.sparkSession
        units = stage(cls._units(rows), "history-units")
        prints = units.where("words is not null").groupBy("h1", "h2").agg(F.first("words").alias("words"))
        total = units.agg(F.sum(F.size("words").cast("long")).alias("n")).first().n or 0
        hot = frequent_words(prints, total)
        made = cls(spark, path or staged_path(spark, "history"), {"number": 0, "parts": [], "frequent": [int(w) for w in hot]})
        made.append(units)
        unstage(units)
        return made

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> History:
        """The history kept in ``path``, as its newest manifest says."""
        system, root = _system(path)
        found = system.get_file_info(fs.FileSelector(posixpath.join(root, "manifests"), allow_not_found=True))
        names = sorted(i.path for i in found if i.path.endswith(".json"))
        if not names:
            raise FileNotFoundError(f"no history in {path}")
        with system.open_input_stream(names[-1]) as file:
            return cls(spark, path, json.loads(file.read()))

    def _commit(self, state: dict) -> None:
        system, root = _system(self.path)
        folder = posixpath.join(root, "manifests")
        system.create_dir(folder, recursive=True)
        waiting = posixpath.join(folder, f"{uuid.uuid4().hex}.waiting")
        with system.open_output_stream(waiting) as file:
            file.write(json.dumps(state).encode())
        system.move(waiting, posixpath.join(folder, f"{state['number']:012d}.json"))
        self.state = state

    @staticmethod
    def _keyed(rows: DataFrame) -> DataFrame:
        good = usable("fingerprint") & F.expr("fingerprint_version = 2 and duration > 0 and not isnan(duration)")
        kept = rows.where("ord is not null").select(
            "ord", "full_hash", F.when(good, F.col("fingerprint")).alias("words"), F.when(good, F.col("duration")).alias("duration")
        )
        return with_class_key(kept.where("full_hash is not null or words is not null"), "words")

    @classmethod
    def _units(cls, rows: DataFrame) -> DataFrame:
        """``unit`` (smallest ord), full_hash, h1, h2, duration, words: rows that are alike in all of these."""
        return cls._keyed(rows).groupBy("full_hash", "h1", "h2", "duration").agg(F.min("ord").alias("unit"), F.first("words").alias("words"))

    def _signatures(self, units: DataFrame) -> DataFrame:
        """Signatures of units with words, one row per fingerprint and duration, with their band."""
        rows = units.where("words is not null").groupBy("h1", "h2", "duration").agg(F.min("unit").alias("ord"), F.first("words").alias("words"))
        rows = rows.select("h1", "h2", "ord", "duration", "words", F.lit(None).cast("array<long>").alias("labels")).mapInArrow(_labels(self.hot), SIGNATURE)
        return rows.withColumn("band", _band())

    def append(self, units: DataFrame) -> None:
        """Make the units of accepted rows part of the history."""
        hashes = units.where("full_hash is not null").groupBy("full_hash").agg(F.min("unit").alias("ord"))
        self._write(hashes, self._signatures(units), units)

    def _write(self, hashes: DataFrame, signatures: DataFrame, sized: DataFrame, merged: list[dict] | None = None) -> None:
        counts = sized.groupBy(F.when(F.col("words").isNotNull(), _band()).alias("band")).agg(F.count("*").alias("n"), F.sum(F.size("words").cast("long")).alias("w")).collect()
        number = self.state["number"] + 1
        buckets = parts_for(sum(r.n for r in counts), HASHES_PER_BUCKET)
        bands = dict(sorted((r.band, parts_for(r.w, WORDS_PER_BUCKET)) for r in counts if r.band is not None))
        hashes = hashes.select("full_hash", "ord", F.pmod(F.xxhash64("full_hash"), F.lit(buckets)).cast("int").alias("bucket"))
        self._save(hashes.repartitionById(buckets, F.col("bucket")), f"hashes/number={number}", "bucket")
        if bands:  # at most one row per duration band: a hundred or so
            firsts = dict(zip(bands, itertools.accumulate([0, *bands.values()])))
            place = F.create_map(*(F.lit(x) for b in bands for x in (b, firsts[b])))[F.col("band")]
            cuts = F.create_map(*(F.lit(x) for b in bands for x in (b, bands[b])))[F.col("band")]
            placed = signatures.drop("band").withColumn("band", _band()).withColumn("bucket", (place + F.pmod(F.xxhash64("h1"), cuts)).cast("int")).drop("band")
            self._save(placed.repartitionById(sum(bands.values()), F.col("bucket")), f"signatures/number={number}", "bucket")
        part = {"number": number, "hashes": buckets, "bands": list(bands.items())}
        kept = [p for p in self.state["parts"] if p not in (merged or [])]
        self._commit({**self.state, "number": number, "parts": [*kept, part]})

    def _save(self, df: DataFrame, name: str, by: str) -> None:
        df.write.mode("overwrite").options(compression="zstd").partitionBy(by).parquet(f"{self.path}/{name}")

    def _read(self, kind: str, numbers: list[int], fields: str) -> DataFrame:
        reader = self.spark.read.schema(fields).option("basePath", f"{self.path}/{kind}")
        return reader.parquet(*(f"{self.path}/{kind}/number={n}" for n in numbers)) if numbers else self.spark.createDataFrame([], fields)

    def compact(self, old: list[dict] | None = None) -> None:
        """Merge live parts (all, or ``old``) into one, with buckets for the size it has now; what they were is deleted afterwards."""
        old = self.state["parts"] if old is None else old
        hashes = self._read("hashes", [p["number"] for p in old], "full_hash string, ord long")
        signatures = self._read("signatures", [p["number"] for p in old if p["bands"]], SIGNATURE)
        sized = signatures.select("words", "duration").unionByName(hashes.select(F.lit(None).cast("array<long>").alias("words"), F.lit(None).cast("double").alias("duration")))
        self._write(hashes.groupBy("full_hash").agg(F.min("ord").alias("ord")), signatures.withColumn("band", _band()), sized, merged=old)
        system, root = _system(self.path)
        for part in old:
            for kind in ("hashes", "signatures"):
                folder = posixpath.join(root, kind, f"number={part['number']}")
                if system.get_file_info(folder).type == fs.FileType.Directory:
                    system.delete_dir(folder)

    def look_up(self, rows: DataFrame) -> Found:
        """What the history holds of ``rows``, in one search for all of them; ``take_in`` then searches only what came later."""
        units = stage(self._units(rows), "rows-units")
        parts = self.state["parts"]
        asked = stage(units.join(self._seen_hashes(units, parts), "unit", "left"), "rows-asked")
        signatures = stage(self._signatures(asked.where("exact is null")), "rows-signatures")
        seen = self._seen_signatures(signatures, parts)
        found = Found(
            frozenset(p["number"] for p in parts),
            stage(asked.where("exact is not null").groupBy("full_hash").agg(F.min("exact").alias("before")), "rows-hashes"),
            stage(seen.withColumnRenamed("old", "older"), "rows-seen"),
        )
        for df in (units, asked, signatures):
            unstage(df)
        return found

    def take_in(self, batch: DataFrame, found: Found | None = None) -> DataFrame:
        """Refused rows of ``batch`` as ``seen_ord, new_ord, how``; all others are accepted and appended.

        ``found`` may give what was looked up before for the batch's rows.
        """
        units = stage(self._units(batch), "batch-units")
        refused = stage(self._refused(batch, units, found), "refused")
        unstage(units)
        later = self._later(found)
        if len(later) > MOST_PARTS:
            self.compact(later)
        return refused

    def _later(self, found: Found | None) -> list[dict]:
        return [p for p in self.state["parts"] if found is None or p["number"] not in found.parts]

    def _refused(self, batch: DataFrame, units: DataFrame, found: Found | None) -> DataFrame:
        parts = self._later(found)
        asked = units.join(self._seen_hashes(units, parts), "unit", "left")
        if found is not None:
            asked = asked.join(found.hashes, "full_hash", "left").select(*units.columns, F.least("exact", "before").alias("exact"))
        asked = stage(asked, "batch-asked")
        signatures = stage(self._signatures(asked.where("exact is null")), "batch-signatures")
        known = asked.join(self._seen_signatures(signatures, parts), ["h1", "h2", "duration"], "left")
        if found is not None:
            known = known.join(found.signatures, ["h1", "h2", "duration"], "left").withColumn("old", F.least("old", "older")).drop("older")
        known = stage(known.withColumn("old", F.when(F.col("exact").isNull() & F.col("words").isNotNull(), F.col("old"))), "batch-known")
        labels = signatures.select("h1", "h2", "duration", "labels")
        open_ = known.where("exact is null and old is null").join(labels, ["h1", "h2", "duration"], "left")
        open_ = open_.select("unit", "full_hash", "h1", "h2", "duration", "words", "labels").repartition(1)
        info = stage(open_.mapInArrow(_decided(self.hot, FIRST_CHUNK), DECIDED), "batch-decided")
        accepted = stage(known.join(info.where("accepted").select("unit"), "unit", "left_semi").select(units.columns), "accepted-units")
        self.append(accepted)
        hashes = accepted.where("full_hash is not null").groupBy("full_hash").agg(F.min("unit").alias("new_exact"))
        told = known.join(info, "unit", "left").select(*_unit_key(), "unit", "exact", "old", "near", F.coalesce("accepted", F.lit(False)).alias("accepted"))
        keyed = self._keyed(batch).select("ord", "full_hash", *_unit_key()).dropDuplicates(["ord"]).join(told, ["own", "h1", "h2", "span"])
        rows = keyed.join(hashes, "full_hash", "left").where("not accepted or ord <> unit")
        by_hash = F.least("exact", F.when(F.col("new_exact") < F.col("ord"), F.col("new_exact")))
        by_words = F.least("old", "near", F.when(F.col("accepted"), F.col("unit")))
        found = rows.select(
            F.coalesce(by_hash, by_words).alias("seen_ord"), F.col("ord").alias("new_ord"),
            F.when(by_hash.isNotNull(), "exact").otherwise("near").alias("how"),
        )
        found = stage(found, "batch-found")
        for df in (asked, signatures, known, info, accepted):
            unstage(df)
        return found

    def _seen_hashes(self, units: DataFrame, parts: list[dict]) -> DataFrame:
        """``unit, exact``: the smallest accepted ord of each unit's hash, from the buckets of ``parts`` the hashes fall into."""
        if not parts:
            return self.spark.createDataFrame([], "unit long, exact long")
        firsts = [0, *itertools.accumulate(p["hashes"] for p in parts)]
        folders = [f"{self.path}/hashes/number={p['number']}/bucket={b}" for p in parts for b in range(p["hashes"])]
        buckets = F.array(*((F.pmod(F.xxhash64("full_hash"), F.lit(p["hashes"])) + F.lit(at)).cast("int") for p, at in zip(parts, firsts)))
        asked = units.where("full_hash is not null").select(F.explode(buckets).alias("bucket"), "unit", "full_hash")
        found = asked.repartitionById(firsts[-1], F.col("bucket")).mapInArrow(_known(folders), "unit long, seen long")
        return found.groupBy("unit").agg(F.min("seen").alias("exact"))

    def _seen_signatures(self, signatures: DataFrame, parts: list[dict]) -> DataFrame:
        """``h1, h2, duration, old``: the smallest accepted ord alike to each signature, from the buckets of the bands around its own.

        The buckets of a band, and the signatures that may meet them, are each cut into sides; a task compares two.
        """
        words = {r.band: r.n for r in signatures.groupBy("band").agg(F.sum(F.size("words").cast("long")).alias("n")).collect()} if parts else {}
        if not words:
            return self.spark.createDataFrame([], "h1 long, h2 long, duration double, old long")
        around = {band: sum(words.get(b, 0) for b in (band - 1, band, band + 1)) for p in parts for band, _ in p["bands"]}
        cuts = parts_for(max(around.values(), default=0), WORDS_PER_SIDE)
        probes = staged_path(self.spark, "probes")
        placed = signatures.withColumn("cut", F.pmod(F.xxhash64("h2"), F.lit(cuts)).cast("int"))
        placed.repartitionById(cuts, F.col("cut")).write.option("compression", "zstd").partitionBy("band", "cut").parquet(probes)
        tiles: list[tuple[list[str], list[str]]] = []
        for part in parts:
            at = 0
            for band, buckets in part["bands"]:
                folders = [f"{self.path}/signatures/number={part['number']}/bucket={at + i}" for i in range(buckets)]
                at += buckets
                if not around[band]:
                    continue
                # as many buckets at once as there are words to compare them with
                per = max(1, min(around[band], WORDS_PER_SIDE) // WORDS_PER_BUCKET)
                for some in np.array_split(np.arange(cuts), parts_for(around[band], WORDS_PER_SIDE)):
                    asked = [f"{probes}/band={b}/cut={c}" for b in (band - 1, band, band + 1) if b in words for c in some.tolist()]
                    tiles += [(folders[i : i + per], asked) for i in range(0, buckets, per)]
        fields = "h1 long, h2 long, duration double, seen long"
        numbers = self.spark.range(0, len(tiles), 1, max(1, len(tiles)))
        found = numbers.mapInArrow(_probed(tiles, self.hot), fields)
        return found.groupBy("h1", "h2", "duration").agg(F.min("seen").alias("old"))


def _band():
    return F.greatest(F.lit(-99), F.least(F.lit(99), F.floor(F.log("duration") / F.lit(BAND)))).cast("int")


def _unit_key() -> list:
    """Columns that tell units apart, none of them null."""
    return [
        F.coalesce(F.concat(F.lit("h"), "full_hash"), F.lit("-")).alias("own"), "h1", "h2",
        F.coalesce("duration", F.lit(-1.0)).alias("span"),
    ]


def refused_rows(files: DataFrame, incoming: DataFrame, *, step_rows: int = STEP_ROWS) -> DataFrame:
    """``seen_ord, new_ord, how`` of all rows of ``incoming`` that repeat ``files`` or an accepted row before them.

    Rows are taken in the order of ord, in steps of about ``step_rows`` rows: small batches together, a
    larger one in parts. Where a batch ends makes no difference to what is refused. ``files`` is searched
    once for all of them; a step searches only what the steps before it accepted.
    """
    history = History.create(files)
    incoming = incoming.where("ord is not null")
    steps = parts_for(incoming.count(), step_rows)
    cuts = sorted(set(incoming.approxQuantile("ord", [i / steps for i in range(1, steps)], 0.001))) if steps > 1 else []
    known = history.look_up(incoming) if cuts else None
    out = None
    for low, high in zip([None, *cuts], [*cuts, None]):
        step = incoming if low is None else incoming.where(F.col("ord") >= low)
        found = history.take_in(step if high is None else step.where(F.col("ord") < high), known)
        out = found if out is None else out.union(found)
    return out
