"""Token ids of a whole corpus by a public byte-level BPE vocabulary, merged in DuckDB.

Each task cuts its texts into words by the vocabulary's pattern, and merges only distinct words it
has not met: one row per byte of each word goes into a recursive query that joins neighbouring
tokens with the merge table, contracts the pairs of lowest rank of each word from the left, and ends
when no word has a pair left; an ordered aggregation gives each word's ids. Texts are put together
from their words' ids by array gathers. Nothing is shuffled.

All occurrences of a word's lowest rank are contracted in one step, overlapping ones from the left:
a merge only creates pairs of higher rank, so the result is that of one contraction at a time.

Defined results: an empty and a null text give an empty list; strings that look like special tokens
are ordinary text; repeated rows come out as often as they are there; texts are taken whole.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ship_package

TOKENIZERS = "/opt/tokenizers"
#: Fixed value: how the byte-level vocabularies cut text into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of words merged in one query, distinct words remembered by a task, and characters of texts put together at once.
QUERY_BYTES, WORDS_KEPT, TEXT_CHARS = 1 << 20, 1 << 19, 1 << 23

MERGE = """
WITH RECURSIVE state(word, pos, token) USING KEY (word, pos) AS (
  SELECT word, pos, token FROM symbols
  UNION
  SELECT word, pos, CASE WHEN gone THEN NULL WHEN chosen THEN made ELSE token END
  FROM (
    SELECT *, coalesce(lag(chosen) OVER (PARTITION BY word ORDER BY pos), false) AS gone
    FROM (
      SELECT *, rank = low AND row_number() OVER (PARTITION BY word, rank = low, run ORDER BY pos) % 2 = 1 AS chosen
      FROM (
        SELECT *, sum(CASE WHEN rank = low THEN 0 ELSE 1 END) OVER (PARTITION BY word ORDER BY pos) AS run
        FROM (
          SELECT s.word, s.pos, s.token, m.rank, m.made, min(m.rank) OVER (PARTITION BY s.word) AS low
          FROM (
            SELECT word, pos, token, lead(token) OVER (PARTITION BY word ORDER BY pos) AS after
            FROM recurring.state
            WHERE token IS NOT NULL AND word IN (SELECT word FROM state)
          ) AS s
          LEFT JOIN merges AS m ON m.first = s.token AND m.second = s.after
        )
      )
    )
  )
  WHERE low IS NOT NULL
)
SELECT word, list(token ORDER BY pos) AS ids FROM state WHERE token IS NOT NULL GROUP BY word ORDER BY word
"""


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in printable}
    for b in range(256):
        letters.setdefault(b, chr(256 + len(letters) - len(printable)))
    return letters


class Vocabulary:
    """Merge table of a byte-level BPE file: small arrays whose size is the vocabulary's."""

    def __init__(self, path: str):
        model = json.loads(Path(path).read_text(encoding="utf-8"))["model"]
        ids = model["vocab"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.first = np.array([ids[a] for a, _ in pairs], np.int32)
        self.second = np.array([ids[b] for _, b in pairs], np.int32)
        self.made = np.array([ids[a + b] for a, b in pairs], np.int32)
        letters = byte_letters()
        self.bytes = np.array([ids[letters[b]] for b in range(256)], np.int32)


class Encoder:
    """Words to ids through DuckDB, each distinct word once."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.words = regex.compile(PATTERN)
        self.engine = duckdb.connect(config={"threads": 1, "memory_limit": "700MB", "temp_directory": ""})
        merges = pa.table(
            {"first": vocabulary.first, "second": vocabulary.second, "made": vocabulary.made, "rank": np.arange(len(vocabulary.made), dtype=np.int32)}
        )
        self.engine.register("merge_rows", merges)
        self.engine.execute("CREATE TABLE merges AS FROM merge_rows")
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.ids: list[np.ndarray] = []
        self.ends = [0]

    def learn(self, words: list[str]) -> None:
        """Merge words not met before, in queries of bounded size."""
        some: list[bytes] = []
        held = 0
        for word in words:
            self.place[word] = len(self.place)
            some.append(word.encode())
            held += len(some[-1])
            if held >= QUERY_BYTES:
                self._merge(some)
                some, held = [], 0
        if some:
            self._merge(some)

    def _merge(self, words: list[bytes]) -> None:
        sizes = np.array([len(w) for w in words])
        symbols = pa.table(
            {
                "word": np.repeat(np.arange(len(words)), sizes),
                "pos": np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes),
                "token": self.vocabulary.bytes[np.frombuffer(b"".join(words), np.uint8)],
            }
        )
        self.engine.register("symbols", symbols)
        merged = self.engine.sql(MERGE).to_arrow_table().column("ids").combine_chunks()
        self.ids.append(merged.values.to_numpy()[merged.offsets[0].as_py() :].astype(np.int32))
        self.ends.extend((self.ends[-1] + np.cumsum(merged.value_lengths().to_numpy())).tolist())

    def encode(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids and their number per text, for runs of texts of bounded length."""
        at = 0
        while at < len(texts):
            to, held = at, 0
            while to < len(texts) and (held < TEXT_CHARS or to == at):
                held += len(texts[to] or "")
                to += 1
            cut = [self.words.findall(t) if t else [] for t in texts[at:to]]
            fresh = dict.fromkeys(w for words in cut for w in words if w not in self.place)
            if len(self.place) + len(fresh) > WORDS_KEPT:
                self.forget()
                fresh = dict.fromkeys(w for words in cut for w in words)
            self.learn(list(fresh))
            if len(self.ids) > 1:
                self.ids = [np.concatenate(self.ids)]
            known, ends = self.ids[0] if self.ids else np.zeros(0, np.int32), np.array(self.ends)
            index = np.array([self.place[w] for words in cut for w in words], np.int64)
            sizes = ends[index + 1] - ends[index]
            until = np.concatenate([[0], np.cumsum(sizes)])
            ids = known[np.arange(until[-1]) - np.repeat(until[:-1] - ends[index], sizes)]
            of_text = np.cumsum([0, *map(len, cut)])
            yield ids, np.diff(until[of_text])
            at = to


def _encoder(vocabulary: Vocabulary, counts_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary)
        for batch in batches:
            keys, at = batch.column(0), 0
            for ids, sizes in encoder.encode(batch.column(1).to_pylist()):
                some = keys.slice(at, len(sizes))
                at += len(sizes)
                if counts_only:
                    yield pa.RecordBatch.from_arrays([some, pa.array(sizes.astype(np.int64))], ["key", "tokens"])
                else:
                    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([some, pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))], ["key", "ids"])

    return run


def _encoded(docs: DataFrame, key: str, text: str, path: str, counts_only: bool) -> DataFrame:
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    out = f"key {kind}, tokens long" if counts_only else f"key {kind}, ids array<int>"
    return rows.mapInArrow(_encoder(Vocabulary(path), counts_only), out).withColumnRenamed("key", key)


def token_ids(docs: DataFrame, key: str = "doc_id", text: str = "text", *, path: str = f"{TOKENIZERS}/byte_bpe_50k.json") -> DataFrame:
    """``key, ids`` of every row: the ids of its text, without special tokens."""
    return _encoded(docs, key, text, path, False)


def token_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", *, path: str = f"{TOKENIZERS}/byte_bpe_50k.json") -> DataFrame:
    """``key, tokens`` of every row: how many ids its text has."""
    return _encoded(docs, key, text, path, True)


def decoded(ids: list[int], path: str = f"{TOKENIZERS}/byte_bpe_50k.json") -> str:
    """The text of a list of ids."""
    vocab = json.loads(Path(path).read_text(encoding="utf-8"))["model"]["vocab"]
    back, letters = {i: t for t, i in vocab.items()}, {c: b for b, c in byte_letters().items()}
    return bytes(letters[c] for i in ids for c in back[i]).decode("utf-8", "replace")
