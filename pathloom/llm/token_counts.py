"""Token counts without token ids.

The tokenizer never merges across certain places, so a text is a bag of *pre-tokens*: a run of blanks with the word after
it, a blank run at the end of a line, or a line feed; a long one is cut further wherever two neighbouring letters stand
together in no piece of the vocabulary. Each distinct pre-token of the corpus is given to the tokenizer once; its pieces,
times how often it stands in a document, add up to the document's tokens.

Common pre-tokens go to all tasks with their counts and are summed where a text is read: those in two or more of ``SAMPLE``
documents drawn by a hash, as many as ``COMMON`` and ``COMMON_BYTES`` allow, the most frequent ones. That draw decides on the
way alone, not on any count. Whatever else stands in a document leaves as (pre-token, frequency) pairs; their distinct
pre-tokens are counted, once each, and joined with the pairs. A pre-token of a large share of the documents is among the
common ones, so no key of the join is.

Defined results: a null or empty text has no bytes and no tokens; a blank text has the tokens of its blanks; equal rows (and
rows of a null id) have a row each; an empty table gives none. Other columns are left out, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.llm._text import batch_of, columns
from pathloom.plans.durable import durable

LIMIT = 4096
#: Documents that tell the common pre-tokens, and how many of those are broadcast, by number and by bytes.
SAMPLE, COMMON, COMMON_BYTES = 100_000, 300_000, 16 << 20
#: Letters of a pre-token beyond which it is cut further.
LONG = 64
#: Distinct pre-tokens that a task holds before it hands them on.
HELD = 200_000

_SPACE = "▁"  # stands for a blank inside the model
_PROBE = " ﬁ  Å　x\n y "


class Pieces:
    """A BPE model with a blank before each text, no normalisation, and no piece that spans a word's end or a line feed."""

    _CUT = re.compile("\n+| *[^ \n]+| +")

    def __init__(self, path: str):
        import sentencepiece

        self.model = model = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        if model.normalize(_PROBE) != _SPACE + _PROBE.replace(" ", _SPACE) or any("\n" in p or _SPACE in p.lstrip(_SPACE) for p in plain):
            raise ValueError(f"{path}: pieces of this model may span the ends of pre-tokens")
        self.pairs = {a + b for p in plain for a, b in zip(p, p[1:], strict=False)}

    def cut(self, text: str) -> Counter:
        """How often each pre-token stands in the text."""
        if not text:
            return Counter()
        found = Counter(self._CUT.findall(" " + text.replace(_SPACE, " ")))
        for t in [t for t in found if len(t) > LONG]:
            n = found.pop(t)
            for part, k in self._apart(t).items():
                found[part] += n * k
        return found

    def _apart(self, t: str) -> Counter:
        if t[0] == "\n":
            return Counter({"\n": len(t)})
        inner = t.replace(" ", _SPACE)
        ends = [0, *[i for i in range(1, len(t)) if inner[i - 1 : i + 1] not in self.pairs], len(t)]
        return Counter(t[a:b] for a, b in zip(ends, ends[1:], strict=False))

    def count(self, token: str) -> int:
        """Pieces of a pre-token. One that starts with a blank has the model's own; another goes behind a line feed, which
        with that blank is two pieces more."""
        if token[0] == " " and len(token) > 1:
            return len(self.model.encode(token[1:]))
        if token == " ":
            return 1
        return len(self.model.encode("\n" + token)) - 2


@lru_cache(maxsize=2)
def _pieces(path: str) -> Pieces:
    return Pieces(path)


def _texts(column: pa.Array) -> Iterator[str]:
    return (x or "" for x in column.to_pylist())


_FOUND = pa.schema([("token", pa.string()), ("docs", pa.int64())])


def _found(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """Distinct pre-tokens of a task with the number of texts that have them."""
    model, held = _pieces(path), Counter()
    for batch in batches:
        for text in _texts(batch.column(0)):
            held.update(model.cut(text).keys())
            if len(held) >= HELD:
                yield batch_of(_FOUND, [list(held), list(held.values())])
                held = Counter()
    yield batch_of(_FOUND, [list(held), list(held.values())])


def _counted(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    model = _pieces(path)
    for batch in batches:
        yield batch_of(pa.schema([("token", pa.string()), ("pieces", pa.int64())]), [batch.column(0), [model.count(t) for t in batch.column(0).to_pylist()]])


def dictionary(tokens: DataFrame, path: str) -> DataFrame:
    """The pieces of each of some distinct pre-tokens: ``token, pieces``."""
    return tokens.select("token").mapInArrow(lambda it: _counted(it, path), "token string, pieces long")


def common(docs: DataFrame, path: str, most: int = COMMON, sample: int = SAMPLE) -> dict[str, int]:
    """Pre-tokens in at least so many of the drawn documents, the least power of two from two up that the bounds allow."""
    share = min(1.0, sample / max(1, docs.count()))
    drawn = docs.where(F.pmod(F.xxhash64("_id", F.length("_text")), F.lit(1 << 30)) <= int(share * (1 << 30)))
    found = durable(drawn.select("_text").mapInArrow(lambda it: _found(it, path), "token string, docs long").groupBy("token").agg(F.sum("docs").alias("docs")).where("docs > 1"))
    sizes = {r["p"]: r for r in found.groupBy(F.floor(F.log2("docs")).alias("p")).agg(F.count("*").alias("n"), F.sum(F.octet_length("token")).alias("bytes")).collect()}
    total, size, least = 0, 0, None
    for p in sorted(sizes, reverse=True):
        total, size = total + sizes[p]["n"], size + sizes[p]["bytes"]
        if total > most or size > COMMON_BYTES:
            break
        least = p
    return {} if least is None else {r["token"]: r["pieces"] for r in dictionary(found.where(F.floor(F.log2("docs")) >= least), path).collect()}


def _sums(batches: Iterator[pa.RecordBatch], path: str, known: Broadcast) -> Iterator[pa.RecordBatch]:
    model, pieces = _pieces(path), known.value
    for batch in batches:
        schema = pa.schema([batch.schema.field(0), ("n_bytes", pa.int64()), ("known", pa.int64()), ("rest", pa.list_(pa.struct([("token", pa.string()), ("n", pa.int64())])))])
        rows = []
        for text in _texts(batch.column(1)):
            total, rest = 0, []
            for token, n in model.cut(text).items():
                k = pieces.get(token)
                if k is None:
                    rest.append({"token": token, "n": n})
                else:
                    total += n * k
            rows.append((len(text.encode()), total, rest))
        yield batch_of(schema, [batch.column(0), *columns(rows, 3)])


def count(documents: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, most: int = COMMON) -> DataFrame:
    """Per row: its id, ``n_bytes, n_tokens, over_limit``."""
    kind = documents.schema[id_col].dataType.simpleString()
    docs = documents.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    known = documents.sparkSession.sparkContext.broadcast(common(docs, model_path, most))
    sums = docs.mapInArrow(lambda it: _sums(it, model_path, known), f"_id {kind}, n_bytes long, known long, rest array<struct<token:string,n:long>>")
    held = durable(sums.withColumn("_row", F.monotonically_increasing_id()))  # a row's number is fixed once it is written
    rest = held.select("_row", F.inline("rest"))
    words = dictionary(rest.select("token").distinct(), model_path)
    more = rest.join(words, "token").groupBy("_row").agg(F.sum(F.col("n") * F.col("pieces")).alias("more"))
    total = F.col("known") + F.coalesce("more", F.lit(0))
    return held.drop("rest").join(more, "_row", "left").select(F.col("_id").alias(id_col), "n_bytes", total.alias("n_tokens"), (total > limit).alias("over_limit"))
