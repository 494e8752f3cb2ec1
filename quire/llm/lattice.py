"""SentencePiece encoding and decoding over a relational lattice of pieces.

Texts are cut into units that no piece crosses: a run of spaces with what follows
it.  Units that occur often are encoded as relations: their substrings of bounded
length are exploded, joined to the piece table by equality, and the edges found
are grouped by unit and folded with a higher-order aggregate.  For a unigram model
the fold is Viterbi's.  A byte-pair model has no additive score that Viterbi could
maximise, so for it the fold applies, over the same edges, the merge with the best
score among those that join two present symbols, until none is left.

The dictionary of frequent units has a bound and is sent to every task, where it
answers nearly all units of the texts; the long tail, which no bounded dictionary
can hold and whose join would move several times the corpus, is encoded in the task
that holds the text, by plain merges or Viterbi in Python that agree with the fold.
"""

from __future__ import annotations

import heapq
import marshal
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.runtime import cut, ready

SPACE = "▁"
UNIT = rf"{SPACE}+[^{SPACE}\n\t]*|[^{SPACE}\n\t]+|[\n\t]"
_UNIT = re.compile(UNIT)
_HEAD = "\x01"  # marks the head of a line while words are counted
LONGEST_UNIT = 60  # of the dictionary; its symbols' borders are bits of one long
DICTIONARY = 1 << 18  # most units of the dictionary
CACHED_UNITS = 60_000  # most units of the tail that a worker remembers
_UNKNOWN_PENALTY = 10.0


@dataclass
class PieceTable:
    """A model's pieces; ``merges`` says whether scores are priorities of merges or log-probabilities."""

    pieces: list[str]  # of every id
    scores: dict[str, float]  # of the pieces that match text
    ids: dict[str, int]
    bytes_from: int  # id of byte zero, or -1
    unknown: int
    merges: bool
    longest: int
    joined: set[str] = field(default_factory=set)  # two characters that stand together in some piece
    cache: dict = field(default_factory=dict)

    def __getstate__(self):
        return self.__dict__ | {"cache": {}}

    @property
    def unknown_score(self) -> float:
        return min(self.scores.values()) - _UNKNOWN_PENALTY

    def plain(self, symbol: str) -> list[int]:
        """Ids of one symbol: its own, or those of its bytes."""
        known = self.ids.get(symbol)
        if known is not None:
            return [known]
        return [self.bytes_from + b for b in symbol.encode("utf-8", "replace")] if self.bytes_from >= 0 else [self.unknown]

    def encode_unit(self, unit: str) -> bytes:
        """Ids of one unit as 32-bit integers."""
        if not self.merges:
            symbols = self._viterbi(unit)
        else:
            symbols = self._merge_short(unit) if len(unit) <= LONGEST_UNIT else self._merge(unit)
        try:
            return array("i", [self.ids[s] for s in symbols]).tobytes()
        except KeyError:  # a character outside the vocabulary
            return array("i", [i for s in symbols for i in self.plain(s)]).tobytes()

    def _merge_short(self, unit: str) -> list[str]:
        """The same merges as ``_merge``, without a heap."""
        get, none, symbols = self.scores.get, float("-inf"), list(unit)
        pairs = [get(a + b, none) for a, b in zip(symbols, symbols[1:], strict=False)]
        while pairs and (best := max(pairs)) > none:
            i = pairs.index(best)
            symbols[i] += symbols.pop(i + 1)
            del pairs[i]
            if i < len(pairs):
                pairs[i] = get(symbols[i] + symbols[i + 1], none)
            if i:
                pairs[i - 1] = get(symbols[i - 1] + symbols[i], none)
        return symbols

    def _merge(self, unit: str) -> list[str]:
        n, scores = len(unit), self.scores
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [1] * n  # symbol at i ends at i + alive[i]
        heap: list[tuple[float, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n:
                size = alive[i] + alive[j]
                if size <= self.longest and (s := scores.get(unit[i : i + size])) is not None:
                    heapq.heappush(heap, (-s, i, size))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, size = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or alive[i] + alive[j] != size:
                continue
            alive[i], alive[j], after[i] = size, 0, after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [unit[i : i + alive[i]] for i in range(n) if alive[i]]

    def _viterbi(self, unit: str) -> list[str]:
        n, scores, unknown = len(unit), self.scores, self.unknown_score
        best, back = [0.0] + [float("-inf")] * n, [0] * (n + 1)
        for i in range(n):
            for j in range(i + 1, min(n, i + self.longest) + 1):
                s = scores.get(unit[i:j])
                if s is None and j == i + 1:
                    s = unknown
                if s is not None and best[i] + s > best[j]:
                    best[j], back[j] = best[i] + s, i
        cuts = [n]
        while cuts[-1]:
            cuts.append(back[cuts[-1]])
        cuts.reverse()
        return [unit[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def load(path: str, merges: bool | None = None) -> PieceTable:
    """Reads a SentencePiece model on the driver; ``merges`` overrides what the model says its scores mean."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    norm, kinds = model.normalizer_spec, proto.ModelProto.SentencePiece
    if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not norm.escape_whitespaces:
        raise ValueError("only models that keep text as it is, behind one leading space, are read")
    if model.trainer_spec.model_type not in (proto.TrainerSpec.UNIGRAM, proto.TrainerSpec.BPE):
        raise ValueError("only unigram and byte-pair models are read")
    scores, ids = {}, {}
    for i, p in enumerate(model.pieces):
        if p.type == kinds.NORMAL:
            scores[p.piece], ids[p.piece] = p.score, i
        elif p.type not in (kinds.UNKNOWN, kinds.CONTROL, kinds.BYTE, kinds.UNUSED):
            raise ValueError("pieces that a user defined aren't read")
    if any(len(p) > 1 and re.search(rf"[\n\t]|[^{SPACE}]{SPACE}", p) for p in scores):
        raise ValueError("a piece crosses the border of two units")
    byte_ids = [i for i, p in enumerate(model.pieces) if p.type == kinds.BYTE]
    unknown = next(i for i, p in enumerate(model.pieces) if p.type == kinds.UNKNOWN)
    merging = model.trainer_spec.model_type == proto.TrainerSpec.BPE if merges is None else merges
    return PieceTable([p.piece for p in model.pieces], scores, ids, byte_ids[0] if byte_ids else -1, unknown, merging, max(map(len, scores)), {p[i : i + 2] for p in scores for i in range(len(p) - 1)})


def unit_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """``unit`` and ``n``: how often each word stands in all texts, behind its space or at the head of a line.

    A word after several spaces counts as one after a single space; that only
    bears on what is worth a place in the dictionary.
    """
    text = F.col(text_col)
    for end in "\n\t":
        text = F.replace(text, F.lit(end), F.lit(f" {_HEAD}"))
    words = docs.where(F.length(text_col) > 0).select(F.explode(F.split(text, " ", -1)).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    unit = F.when(F.startswith("w", F.lit(_HEAD)), F.expr("substring(w, 2)")).otherwise(F.concat(F.lit(SPACE), F.col("w")))
    return words.select(unit.alias("unit"), "n").where("unit <> ''")


def frequent_units(docs: DataFrame, text_col: str, most: int = DICTIONARY) -> DataFrame:
    """Units of ``docs`` from the lowest frequency on at which there are no more than ``most``.

    All words of all texts are counted; frequencies are told apart by quarters of
    a power of two, so a handful of numbers comes to the driver.
    """
    counts = unit_counts(docs, text_col).where((F.col("n") > 1) & (F.length("unit") <= LONGEST_UNIT)).groupBy("unit").agg(F.sum("n").alias("n"))
    counts = cut(counts.select("unit", F.floor(4 * F.log2("n")).alias("level")))
    held, least = 0, None
    for row in counts.groupBy("level").agg(F.count("*").alias("units")).orderBy(F.desc("level")).collect():
        held += row.units
        if held > most:
            break
        least = row.level
    return counts.where(F.col("level") >= (least if least is not None else 1 << 20)).select("unit")


def encode_units(units: DataFrame, table: PieceTable) -> DataFrame:
    """``unit`` and ``ids`` of distinct units of at most ``LONGEST_UNIT`` characters, by the relational lattice."""
    spark = units.sparkSession
    schema = "piece string, id int, score double"
    pieces = spark.createDataFrame([(p, table.ids[p], float(s)) for p, s in table.scores.items()], schema)  # the vocabulary, whose size the model fixes
    parts = f"flatten(transform(sequence(1, length(unit)), i -> transform(sequence(1, least({table.longest}, length(unit) - i + 1)), n -> struct(i - 1 as a, i - 1 + n as b, substring(unit, i, n) as piece))))"
    found = units.select("unit", F.expr(f"explode({parts}) as e")).select("unit", "e.*").join(F.broadcast(pieces), "piece")
    edges = found.groupBy("unit").agg(F.collect_list(F.struct("a", "b", "id", "score")).alias("edges"))
    known = units.join(edges, "unit", "left").withColumn("edges", F.coalesce("edges", F.expr("cast(array() as array<struct<a:int,b:int,id:int,score:double>>)")))
    cuts = _merged_cuts() if table.merges else _viterbi_cuts(table.unknown_score)
    known = known.withColumn("cuts", F.expr(cuts))
    if table.bytes_from >= 0:
        other = f"transform(sequence(0, octet_length(s) - 1), k -> cast(conv(substring(hex(encode(s, 'UTF-8')), 2 * k + 1, 2), 16, 10) as int) + {table.bytes_from})"
    else:
        other = f"array({table.unknown})"
    symbol = "substring(unit, cuts[k - 1] + 1, cuts[k] - cuts[k - 1])"
    own = "filter(edges, e -> e.a = cuts[k - 1] and e.b = cuts[k])"
    spelled = f"flatten(transform(array({symbol}), s -> {other}))"
    return known.select("unit", F.expr(f"flatten(transform(sequence(1, size(cuts) - 1), k -> if(size({own}) > 0, transform(slice({own}, 1, 1), e -> e.id), {spelled})))").alias("ids"))


def _merged_cuts() -> str:
    """Borders of the symbols after all merges: bits of a long, from which each step takes the one inside the best edge."""
    inside = "(shiftleft(1L, e.b) - shiftleft(1L, e.a + 1))"
    ready_ = f"(shiftright(m, e.a) & 1) = 1 and (shiftright(m, e.b) & 1) = 1 and bit_count(m & {inside}) = 1"
    best = f"array_max(transform(filter(edges, e -> {ready_}), e -> struct(e.score as score, -e.a as a, e.b as b)))"
    step = f"aggregate(array({best}), m, (z, x) -> if(x is null, z, z & ~(shiftleft(1L, x.b) - shiftleft(1L, 1 - x.a))))"
    mask = f"aggregate(sequence(1, length(unit)), shiftleft(1L, length(unit) + 1) - 1, (m, i) -> {step})"
    return f"aggregate(array({mask}), cast(array() as array<int>), (z, m) -> filter(sequence(0, length(unit)), k -> (shiftright(m, k) & 1) = 1))"


def _viterbi_cuts(unknown: float) -> str:
    """Borders of the best path; of equal scores the longer last piece wins."""
    into = "transform(filter(edges, e -> e.b = i), e -> struct(s.best[e.a] + e.score as score, -e.a as a))"
    alone = f"if(exists(edges, e -> e.b = i and e.a = i - 1), cast(array() as array<struct<score:double,a:int>>), array(struct(s.best[i - 1] + {unknown}D as score, 1 - i as a)))"
    step = f"aggregate(array(array_max(concat({into}, {alone}))), s, (z, x) -> struct(concat(z.best, array(x.score)) as best, concat(z.back, array(-x.a)) as back))"
    path = f"aggregate(sequence(1, length(unit)), struct(array(0D) as best, array(0) as back), (s, i) -> {step}).back"
    walk = "aggregate(sequence(1, size(p)), array(size(p) - 1), (c, i) -> if(c[0] = 0, c, concat(array(p[c[0]]), c)))"
    return f"aggregate(array({path}), cast(array() as array<int>), (z, p) -> {walk})"


def dictionary(docs: DataFrame, table: PieceTable, text_col: str = "text", most: int = DICTIONARY) -> dict[str, bytes]:
    """The frequent units of ``docs`` and their ids; at most ``most`` entries come to the driver."""
    rows = encode_units(frequent_units(docs, text_col, most), table).toArrow()
    values = rows.column("ids").combine_chunks().cast(pa.list_(pa.int32()))
    if isinstance(values, pa.ChunkedArray):
        values = pa.concat_arrays(values.chunks) if values.num_chunks else pa.array([], values.type)
    flat, offsets = values.flatten().to_numpy(), values.offsets.to_numpy() - (values.offsets[0].as_py() if len(values) else 0)
    return {u: flat[a:b].tobytes() for u, a, b in zip(rows.column("unit").to_pylist(), offsets[:-1], offsets[1:], strict=True)} if len(values) else {}


class Lexicon(dict):
    """Units and their ids; it travels marshalled, which takes no memory beyond its own to unpack."""

    def __reduce__(self):
        return _unpacked, (marshal.dumps(dict(self), 2),)


def _unpacked(raw: bytes) -> Lexicon:
    return Lexicon(marshal.loads(raw))


def encode_text(text: str, table: PieceTable, known: dict[str, bytes]) -> bytes:
    """Ids of a whole text as 32-bit integers."""
    if not text:
        return b""
    units = _UNIT.findall(SPACE + text.replace(" ", SPACE))
    out, at = list(map(known.get, units)), -1
    try:
        while True:
            at = out.index(None, at + 1)
            out[at] = _rare(units[at], table, known)
    except ValueError:  # no unit is left without ids
        return b"".join(out)


def _rare(unit: str, table: PieceTable, known: dict[str, bytes]) -> bytes:
    """Ids of a unit outside the dictionary."""
    ids = table.cache.get(unit)
    if ids is None:
        # where no piece reaches over to the last character, often a comma, the rest may be known
        head = known.get(unit[:-1]) if unit[-2:] not in table.joined else None
        ids = head + table.encode_unit(unit[-1]) if head else table.encode_unit(unit)
        if len(unit) <= LONGEST_UNIT:
            if len(table.cache) >= CACHED_UNITS:
                table.cache.clear()
            table.cache[unit] = ids
    return ids


def encode(docs: DataFrame, table: PieceTable, text_col: str = "text", most: int = DICTIONARY) -> DataFrame:
    """Adds ``piece_ids`` (array of int) and ``n_pieces`` to every row; columns of these names are replaced.

    A null text has null ids and null pieces, an empty one none.  Characters
    outside the vocabulary become their bytes.  Whole texts are encoded however
    long; repeated rows are encoded alike.
    """
    spark = ready(docs.sparkSession)
    rest = [c for c in docs.columns if c not in ("piece_ids", "n_pieces")]
    docs = docs.select(*[F.col(f"`{c}`") for c in rest])
    shared = spark.sparkContext.broadcast((table, Lexicon(dictionary(docs, table, text_col, most))))  # at most ``most`` units
    schema = T.StructType([*docs.schema.fields, T.StructField("piece_ids", T.ArrayType(T.IntegerType())), T.StructField("n_pieces", T.LongType())])
    place = rest.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, known = shared.value
        for batch in batches:
            texts = batch.column(place).to_pylist()
            raw = [encode_text(t or "", pieces, known) for t in texts]
            sizes = np.array([len(r) // 4 for r in raw], np.int64)
            lost = np.array([t is None for t in texts], bool)
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), mask=np.append(lost, False))
            ids = pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(raw), np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns, ids, pa.array(sizes, mask=lost)], schema.fieldNames())

    return docs.mapInArrow(run, schema)


def decode(encoded: DataFrame, table: PieceTable, ids_col: str = "piece_ids") -> DataFrame:
    """Adds ``decoded``, the text of the ids, to every row; null ids give null, and ids outside the table are left out."""
    ready(encoded.sparkSession)
    rest = [c for c in encoded.columns if c != "decoded"]
    encoded = encoded.select(*[F.col(f"`{c}`") for c in rest])
    schema = T.StructType([*encoded.schema.fields, T.StructField("decoded", T.StringType())])
    place, matched = rest.index(ids_col), set(table.ids.values())
    spelled = [p.replace(SPACE, " ").encode() if i in matched else b"" for i, p in enumerate(table.pieces)]
    if table.bytes_from >= 0:
        spelled[table.bytes_from : table.bytes_from + 256] = [bytes([b]) for b in range(256)]
    size = len(spelled)
    spelled.append(b"")  # of ids that are null or outside the table

    def text(ids: np.ndarray) -> str:
        raw = b"".join(map(spelled.__getitem__, ids.tolist()))
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(place)
            ids = lists.values.fill_null(size).to_numpy(zero_copy_only=False)
            ids = np.where((ids >= 0) & (ids < size), ids, size)
            cuts, lost = lists.offsets.to_numpy(), lists.is_null().to_numpy(zero_copy_only=False)
            texts = [None if n else text(ids[a:b]) for a, b, n in zip(cuts[:-1], cuts[1:], lost, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], schema.fieldNames())

    return encoded.mapInArrow(run, schema)
