"""Byte-level BPE by recursive queries: every task runs DuckDB over the distinct pieces of its texts.

A text is cut into pieces by the tokenizer's pattern. A piece is a row with the list of its tokens, each beside the rank of its merge with the
next; a recursive query contracts the piece's leftmost pair of the lowest rank, joins the two new pairs to the table of merges and goes on
until no pair merges. The bytes of a list of ids (:func:`decode`) are an aggregate ordered by position. A piece is merged
once per slice of texts, not once per occurrence. Words, pieces and lists of ids are Arrow and numpy arrays, so that
Python sees distinct words only. Whole texts are decoded from their ids by a gather of the tokens' bytes in the
same order: as a statement over all ids of all texts that took half as much time again as the encoding.
"""

from __future__ import annotations

import base64
from bisect import bisect
from collections.abc import Callable, Iterator
from itertools import chain
from typing import NamedTuple

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from themeloom.llm.common import expanded, no_collection, offsets, slices, table

SLICE = 8 << 20
PIECES = 20_000
WORDS = 50_000
MEMO = 250_000
LONG = 64
DUCK_MEMORY = "200MB"
# Ids that are decoded, and lists that are gathered, at once.
DECODED = 1_000_000
GATHERED = 200_000
# Stands for no merge and for no token; ids have to be below it.
NONE = (1 << 20) - 1

# A row is a piece w and its tokens e, each an entry (rank k of the merge with the next token, token t) in one number, between two ends
# that merge with nothing. A round contracts the piece's leftmost pair of the lowest rank, whose entry is the least and the first of its
# value, and looks up the two new pairs.
_ENCODE = f"""
WITH RECURSIVE step(w, e, low) AS (
  SELECT w, e, list_min(e) FROM pieces
  UNION ALL
  SELECT w, e, list_min(e)
  FROM (
    SELECT s.w, list_concat(
      list_slice(s.e, 1, s.n - 2),
      [CAST(coalesce(a.k, {NONE}) AS BIGINT) << 20 | s.t, CAST(coalesce(b.k, {NONE}) AS BIGINT) << 20 | s.k],
      list_slice(s.e, s.n + 2, len(s.e))
    ) AS e
    FROM (
      SELECT w, e, n, low >> 20 AS k, e[n - 1] & {NONE} AS t, e[n + 2] & {NONE} AS u
      FROM (SELECT w, e, low, list_position(e, low) AS n FROM step WHERE low >> 20 < {NONE})
    ) s
    LEFT JOIN merges a ON a.pair = (s.t << 20 | s.k)
    LEFT JOIN merges b ON b.pair = (s.k << 20 | s.u)
  )
)
SELECT w, e AS ids FROM step WHERE low >> 20 = {NONE}
"""

# Long pieces go through the same contraction as one statement a round, so that no earlier round is kept, and with all
# places of the lowest rank at once: of a run of overlapping pairs every second one, the leftmost first.
_LONG_ROUND = """
  SELECT w, i, CASE WHEN hit AND turn % 2 = 1 THEN k ELSE t END AS t, best IS NOT NULL AS live
  FROM (
    SELECT *, coalesce(lag(hit AND turn % 2 = 1) OVER (PARTITION BY w ORDER BY i), false) AS gone
    FROM (
      SELECT *, n - coalesce(max(CASE WHEN NOT hit THEN n END) OVER (PARTITION BY w ORDER BY i), 0) AS turn
      FROM (
        SELECT *, coalesce(k = min(k) OVER (PARTITION BY w), false) AS hit, min(k) OVER (PARTITION BY w) AS best
        FROM (
          SELECT p.w, p.i, p.t, p.n, m.k
          FROM (
            SELECT w, i, t, row_number() OVER piece AS n, (CAST(t AS BIGINT) << 20) | lead(t) OVER piece AS pair
            FROM step WHERE live WINDOW piece AS (PARTITION BY w ORDER BY i)
          ) p LEFT JOIN merges m ON m.pair = p.pair
        )
      )
    )
  ) WHERE NOT gone
"""

_FINISHED = "SELECT w, list(t ORDER BY i) AS ids FROM finished GROUP BY w"

_DECODE = """
SELECT w, unhex(string_agg(h, '' ORDER BY i)) AS decoded FROM ids JOIN vocabulary USING (t) GROUP BY w
"""


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and ranks of a file with a base64 token and its rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def unicode_spaces(pattern: str) -> str:
    """The pattern with ``\\s`` and ``\\S`` spelled as Unicode's white space, which leaves out four control characters."""
    return pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")


class Tables:
    """Vocabulary and merges as arrays that travel to the tasks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        """For tasks: ``vars`` of an instance are plain values, and ``of`` makes one from them."""
        self.ranks = ranks
        self.pattern = unicode_spaces(pattern)
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"bytes without a token: {missing[:5]}")
        if max(ranks.values()) >= NONE:
            raise ValueError(f"ids have to be below {NONE}")
        merges = [
            (left << 20 | right, rank)
            for token, rank in ranks.items()
            for cut in range(1, len(token))
            if (left := ranks.get(token[:cut])) is not None and (right := ranks.get(token[cut:])) is not None
        ]
        self.pairs = np.array([p for p, _ in merges], np.int64)
        self.merged = np.array([k for _, k in merges], np.int32)
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.byte_pairs = np.array([[ranks.get(bytes([a, b]), NONE) for b in range(256)] for a in range(256)], np.int32)

    @classmethod
    def of(cls, values: dict) -> Tables:
        tables = cls.__new__(cls)
        tables.__dict__.update(values)
        return tables


class Lists(NamedTuple):
    """Lists of ids: where each begins in ``flat``, and its length."""

    flat: np.ndarray
    first: np.ndarray
    size: np.ndarray

    @classmethod
    def of(cls, lists: list[bytes]) -> Lists:
        """Lists of little-endian 32-bit ids."""
        size = np.fromiter(map(len, lists), np.int64, len(lists)) // 4
        return cls(np.frombuffer(b"".join(lists), "<i4"), offsets(size)[:-1], size)

    @classmethod
    def joined(cls, parts: list[Lists]) -> Lists:
        """The lists of all parts, one after the other."""
        at = offsets(np.array([len(part.flat) for part in parts]))
        first = np.concatenate([part.first + start for part, start in zip(parts, at)])
        return cls(np.concatenate([part.flat for part in parts]), first, np.concatenate([part.size for part in parts]))

    def take(self, chosen: np.ndarray) -> Lists:
        return Lists(self.flat, self.first[chosen], self.size[chosen])

    def of_each(self, chosen: np.ndarray, ends: np.ndarray) -> Lists:
        """New lists, each of the chosen lists between two ``ends``, in one flat order."""
        flat = [self.flat[:0]]
        for start in range(0, len(chosen), GATHERED):
            part = self.take(chosen[start : start + GATHERED])
            flat.append(self.flat[expanded(part.first, part.first + part.size)[1]])
        at = offsets(self.size[chosen])[ends]
        return Lists(np.concatenate(flat), at[:-1], np.diff(at))

    def slices(self) -> list[bytes]:
        """Each list as little-endian 32-bit ids."""
        flat = self.flat.astype("<i4", copy=False).tobytes()
        return [flat[4 * a : 4 * (a + n)] for a, n in zip(self.first.tolist(), self.size.tolist())]


class Encoder:
    """Texts to ids, and ids to bytes, with DuckDB in this process; bounded memos keep what was seen before."""

    def __init__(self, tables: Tables, kept: int = MEMO):
        self.tables = tables
        self.most = kept
        self.cut = regex.compile(tables.pattern)
        self.memo: dict[bytes, bytes] = {}
        self.after_space: dict[str, bytes] = {}
        self.tokens = pa.array(tables.ranks, pa.binary())
        self.token_ids = np.fromiter(tables.ranks.values(), np.int32, len(tables.ranks))
        spelled = [b""] * (int(self.token_ids.max()) + 1)
        for token, rank in tables.ranks.items():
            spelled[rank] = token
        self.spelled = pa.array(spelled, pa.binary())
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": DUCK_MEMORY})
        merges = pa.table({"pair": tables.pairs, "k": tables.merged})
        vocabulary = pa.table({"t": pa.array(tables.ranks.values(), pa.int32()), "h": [t.hex() for t in tables.ranks]})
        for name, data in (("merges", merges), ("vocabulary", vocabulary)):
            self.db.register("given", data)
            self.db.sql(f"CREATE TABLE {name} AS SELECT * FROM given")
            self.db.unregister("given")

    def pieces(self, pieces: pa.Array, lasting: np.ndarray) -> Lists:
        """The ids of distinct pieces; those of ``lasting`` pieces that had to be merged are kept for later."""
        # A piece that is a token as a whole is that token.
        found = pc.index_in(pieces, value_set=self.tokens)
        rest = np.flatnonzero(np.asarray(found.is_null()))
        whole = self.token_ids[np.asarray(found.fill_null(0))]
        names = pieces.take(pa.array(rest)).to_pylist()
        known = [self.memo.get(name) for name in names]
        fresh = sorted((n for n, ids in enumerate(known) if ids is None), key=lambda n: len(names[n]))
        parts = [Lists.of([ids for ids in known if ids is not None])]
        places = [rest[[n for n, ids in enumerate(known) if ids is not None]]]
        split = bisect(fresh, LONG, key=lambda n: len(names[n]))
        for part, contract in ((fresh[:split], self._recursive), (fresh[split:], self._in_rounds)):
            for at in range(0, len(part), PIECES):
                own = part[at : at + PIECES]
                order, lists = contract([names[n] for n in own])
                chosen = np.array(own)[order]
                parts.append(lists)
                places.append(rest[chosen])
                for n, ids in zip(chosen.tolist(), lists.slices()):
                    if len(self.memo) >= self.most:
                        break
                    if lasting[rest[n]]:
                        self.memo[names[n]] = ids
        merged = Lists.joined(parts)
        # Each piece is its token or a list of those merged.
        first = np.arange(len(pieces))
        size = np.ones(len(pieces), np.int64)
        where = np.concatenate(places)
        first[where] = len(pieces) + merged.first
        size[where] = merged.size
        return Lists(np.concatenate([whole, merged.flat]), first, size)

    def _recursive(self, pieces: list[bytes]) -> tuple[np.ndarray, Lists]:
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        rank = np.full(len(raw), NONE, np.int64)
        rank[:-1] = self.tables.byte_pairs[raw[:-1], raw[1:]]
        rank[np.cumsum(sizes) - 1] = NONE
        ends = offsets(sizes + 2)
        e = np.full(ends[-1], NONE << 20 | NONE)
        e[np.arange(len(raw)) + np.repeat(2 * np.arange(len(pieces)) + 1, sizes)] = rank << 20 | self.tables.bytes[raw]
        lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(e))
        w, found = self._contracted(pa.table({"w": np.arange(len(pieces), dtype=np.int32), "e": lists}), lambda: self.db.sql(_ENCODE))
        return w, Lists((found.flat & NONE).astype(np.int32), found.first + 1, found.size - 2)

    def _in_rounds(self, pieces: list[bytes]) -> tuple[np.ndarray, Lists]:
        def run() -> duckdb.DuckDBPyRelation:
            self.db.sql("CREATE OR REPLACE TABLE step AS SELECT w, i, t, true AS live FROM pieces")
            self.db.sql("CREATE OR REPLACE TABLE finished AS SELECT w, i, t FROM step WHERE false")
            while self.db.sql("SELECT count(*) FROM step").fetchall()[0][0]:
                self.db.sql(f"CREATE OR REPLACE TABLE contracted AS {_LONG_ROUND}")
                self.db.sql("INSERT INTO finished SELECT w, i, t FROM contracted WHERE NOT live")
                self.db.sql("CREATE OR REPLACE TABLE step AS SELECT * FROM contracted WHERE live")
            return self.db.sql(_FINISHED)

        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        w = np.repeat(np.arange(len(pieces), dtype=np.int32), sizes)
        i = (np.arange(len(w)) - np.repeat(offsets(sizes)[:-1], sizes)).astype(np.int32)
        t = self.tables.bytes[np.frombuffer(b"".join(pieces), np.uint8)]
        return self._contracted(pa.table({"w": w, "i": i, "t": t}), run)

    def _contracted(self, pieces: pa.Table, run: Callable[[], duckdb.DuckDBPyRelation]) -> tuple[np.ndarray, Lists]:
        """The piece numbers and lists of a statement over ``pieces``."""
        self.db.register("pieces", pieces)
        found = run().to_arrow_table()
        self.db.unregister("pieces")
        lists = found.column("ids").combine_chunks()
        size = np.asarray(lists.value_lengths()).astype(np.int64)
        return found.column("w").to_numpy(), Lists(np.asarray(lists.flatten()), offsets(size)[:-1], size)

    def bytes_of(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The tokens' bytes in the order of their places, gathered a bounded number at a time, and where each token's begin and the last's end."""
        parts, sizes = [], []
        for at in range(0, len(ids), DECODED):
            part = self.spelled.take(pa.array(ids[at : at + DECODED]))
            sizes.append(np.asarray(pc.binary_length(part)))
            parts.append(memoryview(part.buffers()[2] or b"")[: sizes[-1].sum()])
        return b"".join(parts), offsets(np.concatenate([[], *sizes]).astype(np.int64))

    def decoded(self, texts: list[bytes]) -> list[bytes]:
        """The bytes of lists of little-endian 32-bit ids."""
        whole, at = self.bytes_of(np.frombuffer(b"".join(texts), "<i4"))
        ends = at[offsets(np.fromiter(map(len, texts), np.int64, len(texts)) // 4)].tolist()
        return [whole[a:b] for a, b in zip(ends, ends[1:])]

    def _cut(self, words: list[str]) -> tuple[pa.Array, np.ndarray]:
        """The pieces of each word after a space, one after the other, and how many each has.

        The words neither begin nor end with white space and hold no space, so a piece that begins with a space begins a word.
        """
        joined = "".join([" " + word for word in words])
        pieces = pa.array(self.cut.findall(joined), pa.string())
        starts = np.flatnonzero(np.asarray(pc.starts_with(pieces, " ")))
        if len(starts) == len(words) and pc.sum(pc.utf8_length(pieces)).as_py() == len(joined):
            return pieces, np.diff(np.append(starts, len(pieces)))
        return self._cut_each([" " + word for word in words])

    def _cut_each(self, runs: list[str]) -> tuple[pa.Array, np.ndarray]:
        own = [self.cut.findall(run) for run in runs]
        return pa.array(chain.from_iterable(own), pa.string()), np.fromiter(map(len, own), np.int64, len(own))

    def _distinct(self, words: list[str], others: list[str]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """The pieces of words after a space and of other runs, as numbers of distinct pieces, and how many each run has."""
        cuts = [self._cut(words[at : at + WORDS]) for at in range(0, len(words), WORDS)] + [self._cut_each(others)]
        pieces = pa.chunked_array([piece for piece, _ in cuts], pa.string()).combine_chunks().dictionary_encode()
        return np.asarray(pieces.indices), np.concatenate([size for _, size in cuts]), pieces.dictionary.cast(pa.binary())

    def runs(self, words: list[str], others: list[str], times: np.ndarray) -> Lists:
        """Ids of runs of text: of words after a space, then of any others; ``times`` is how often each of them occurs."""
        kept = self.after_space
        known = [kept.get(word) for word in words]
        old = np.array([n for n, ids in enumerate(known) if ids is not None], np.int64)
        seen = Lists.of([ids for ids in known if ids is not None])
        new = [word for word, ids in zip(words, known) if ids is None]
        fresh = np.delete(np.arange(len(words) + len(others)), old)
        codes, sizes, pieces = self._distinct(new, others)
        often = np.bincount(codes, np.repeat(times[fresh], sizes), len(pieces)) > 1
        found = self.pieces(pieces, often).of_each(codes, offsets(sizes))
        again = np.flatnonzero(times[fresh[: len(new)]] > 1)[: max(0, self.most - len(kept))]
        kept.update(zip([new[n] for n in again.tolist()], found.take(again).slices()))
        return Lists.joined([found, seen]).take(np.argsort(np.concatenate([fresh, old])))

    def _numbered(self, texts: pa.Array) -> tuple[list[str], list[str], np.ndarray, np.ndarray]:
        """Distinct words after a space, other distinct runs, the numbers of all runs among both, and where each text's begin and the last's end."""
        split = pc.split_pattern(texts, " ")
        ends = offsets(np.asarray(split.value_lengths()))
        parts = split.flatten().dictionary_encode()
        codes, words = np.asarray(parts.indices), parts.dictionary.to_pylist()
        opens = np.array([bool(word[:1].strip()) for word in words], bool)
        closes = np.array([bool(word[-1:].strip()) for word in words], bool)
        leads = np.zeros(len(codes), bool)
        leads[ends[:-1]] = True
        begins = leads.copy()
        begins[1:] |= closes[codes[:-1]] & opens[codes[1:]]
        first = np.flatnonzero(begins).astype(np.int32)
        last = np.append(first[1:], np.int32(len(codes)))
        leads = leads[first]
        # A run of one word after a space is looked up by its word, any other run is made here.
        plain = (last == first + 1) & ~leads & closes[codes[first]]
        looked_up = codes[first[plain]]
        used = np.flatnonzero(np.bincount(looked_up, minlength=len(words)))
        place = np.zeros(len(words), np.int32)
        place[used] = np.arange(len(used))
        numbers: dict[str, int] = {}
        other = [
            numbers.setdefault(("" if lead else " ") + " ".join([words[n] for n in codes[a:b].tolist()]), len(numbers))
            for a, b, lead in zip(first[~plain].tolist(), last[~plain].tolist(), leads[~plain].tolist())
        ]
        run = np.empty(len(first), np.int32)
        run[plain] = place[looked_up]
        run[~plain] = np.array(other, np.int32) + len(used)
        return [words[n] for n in used.tolist()], list(numbers), run, np.searchsorted(first, ends)

    def ids(self, texts: pa.Array) -> Lists:
        """Ids of whole texts.

        A space between two other characters always begins a piece, so texts are cut before it, and the words after it are looked up.
        Where other white space stands at a space, the words on both sides stay in one run.
        """
        words, others, run, ends = self._numbered(texts)
        return self.runs(words, others, np.bincount(run, minlength=len(words) + len(others))).of_each(run, ends)

    def texts(self, texts: list[str]) -> tuple[list[bytes], list[bytes]]:
        """Ids and decoded bytes of whole texts."""
        ids = self.ids(pa.array(texts, pa.string())).slices()
        return ids, self.decoded(ids)

    def columns(self, texts: pa.Array) -> tuple[pa.Array, pa.Array]:
        """Ids and decoded bytes of whole texts as Arrow arrays."""
        ids = self.ids(texts)
        # What is decoded are these ids, whatever text they came from.
        decoded, at = self.bytes_of(ids.flat)
        ends = np.append(ids.first, len(ids.flat))
        buffers = [None, pa.py_buffer(at[ends].astype(np.int32)), pa.py_buffer(decoded)]
        lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.flat))
        return lists, pa.Array.from_buffers(pa.binary(), len(texts), buffers)


def encode(
    docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", slice_bytes: int = SLICE, kept: int = MEMO
) -> DataFrame:
    """``<id, ids, decoded>`` of every row: token ids of the whole text, and the bytes these ids decode to.

    Null texts count as empty and have no ids. Rows with null or repeated ids stay; an empty table gives an empty result; other columns
    are ignored. ``ranks_path`` is read on the driver. A task holds the words of ``slice_bytes`` of text at once and the ids of ``kept``
    words and of as many pieces: smaller numbers take less memory and more time.
    """
    tables = docs.sparkSession.sparkContext.broadcast(vars(Tables(read_ranks(ranks_path), pattern)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Tables.of(tables.value), kept)
        for batch in slices(batches, "text", slice_bytes):
            with no_collection():
                made = pa.RecordBatch.from_arrays([batch.column("id"), *encoder.columns(batch.column("text"))], ["id", "ids", "decoded"])
            yield made
            del made
            pa.default_memory_pool().release_unused()
        # The worker may stay idle beside other work for a while, so nothing is kept in it.
        encoder.db.close()
        del encoder
        pa.default_memory_pool().release_unused()

    narrow = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return narrow.mapInArrow(run, "id bigint, ids array<int>, decoded binary")


def decode(tokens: DataFrame, ranks_path: str, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """``<id, decoded>``: the bytes of every row's ``ids``; null ids or lists count as absent. An id outside the vocabulary is an error."""
    tables = tokens.sparkSession.sparkContext.broadcast(vars(Tables(read_ranks(ranks_path), "")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        db = Encoder(Tables.of(tables.value)).db
        known = pa.array(tables.value["ranks"].values(), pa.int32())
        for batch in batches:
            lists = batch.column("ids")
            sizes = np.asarray(pc.fill_null(lists.value_lengths(), 0))
            t = lists.flatten()
            if t.null_count < len(t) and not pc.all(pc.is_in(t.drop_null(), known)).as_py():
                raise ValueError("an id is not in the vocabulary")
            place = np.arange(len(t))
            db.register("ids", pa.table({"w": np.repeat(np.arange(len(sizes)), sizes), "i": place, "t": t}))
            found = db.sql(_DECODE).to_arrow_table()
            db.unregister("ids")
            texts = [b""] * len(sizes)
            for w, text in zip(found.column("w").to_pylist(), found.column("decoded").to_pylist()):
                texts[w] = text
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.binary())], ["id", "decoded"])

    narrow = tokens.select(F.col(id_col).cast("bigint").alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return narrow.mapInArrow(run, "id bigint, decoded binary")


def token_digests(docs: DataFrame, slice_bytes: int = SLICE, kept: int = MEMO) -> DataFrame:
    """``<doc_id, n_tokens, ids_sha256, decoded_sha256>`` of the public 50k vocabulary."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return encode(docs, path, public_tokenizers.PATTERN, slice_bytes=slice_bytes, kept=kept).select(
        F.col("id").alias("doc_id"),
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(table(spark, sf_dir, "documents"))
