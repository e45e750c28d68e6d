"""Encodings as Spark columns and SQL functions.

`Columns(spark, encoding)` holds the encoding's broadcast. Split, fold, lookups and
policies are Catalyst expressions; what has to merge is an Arrow-batched function,
evaluated once a row, whose worker keeps the ids of pieces it has met. Null text
gives null. Every function works a row at a time, so it holds in streams too.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from lexloom.functions import grammar
from lexloom.operators.registry import Encoding, unnormalized_class

IDS = T.ArrayType(T.IntegerType(), containsNull=False)
TRUNCATED = T.StructType(
    [
        T.StructField("text", T.StringType()),
        T.StructField("bytes", T.IntegerType()),
        T.StructField("total_tokens", T.IntegerType()),
        T.StructField("kept_tokens", T.IntegerType()),
    ]
)
#: Encodings whose memos a worker keeps.
WORKER_MOST = 3
#: Rows whose results a worker hands over at once: the ids of a whole batch of long texts
#: are several times its texts.
ROWS_AT_ONCE = 1000
_WORKER: dict[str, Encoding] = {}
_SENT: dict = {}


def _encoding(broadcast) -> Encoding:
    """This worker's copy, so that memos outlive a batch and a task."""
    found = broadcast.value
    kept = _WORKER.pop(found.fingerprint, found)
    while len(_WORKER) >= WORKER_MOST:  # the one used longest ago goes
        del _WORKER[next(iter(_WORKER))]
    _WORKER[found.fingerprint] = kept
    return kept


def spread(rows: DataFrame) -> DataFrame:
    """Rows over as many partitions as there are cores, where a scan has fewer: one row
    group of a small file would keep all but one core idle. Larger inputs stay as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)


class Columns:
    def __init__(self, spark: SparkSession, encoding: Encoding):
        self.spark, self.encoding = spark, encoding
        # One broadcast for an encoding and application, however often it is used.
        key = spark.sparkContext.applicationId, encoding.fingerprint
        if key not in _SENT:
            _SENT[key] = spark.sparkContext.broadcast(encoding)
        self._sent = _SENT[key]

    def _over(self, of, kind):
        """An iterator function: of(encoding) is made once a task, then mapped over texts."""
        sent = self._sent

        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            each = of(_encoding(sent))
            for batch in batches:
                for at in range(0, len(batch), ROWS_AT_ONCE):
                    some = batch.iloc[at : at + ROWS_AT_ONCE]
                    yield pd.Series([None if x is None else each(x) for x in some], dtype=object)

        return F.pandas_udf(run, kind)

    # splitting

    def pieces(self, text: Column) -> Column:
        return self.encoding.grammar.pieces(grammar.fold_marker(text) if self.encoding.fold else text)

    def normalized(self, text: Column) -> Column:
        """The text as this encoding's public counts take it: NFC only where needed."""
        return self._over(lambda e: e.prepare, T.StringType())(text) if self.encoding.nfc else text

    def unnormalized(self, text: Column) -> Column:
        """Whether NFC might change the text; never false where it would."""
        return text.rlike(f"[{unnormalized_class()}]")

    # encoding

    def encode(self, text: Column) -> Column:
        """Ids, special strings as plain text."""
        return self._over(lambda e: e.encode_ordinary, IDS)(text)

    def encode_bytes(self, data: Column) -> Column:
        return self._over(lambda e: lambda x: e.encode_bytes(bytes(x)), IDS)(data)

    def encode_special(self, text: Column, allowed_special="all", disallowed_special=()) -> Column:
        """Ids; allowed specials become their ids and refused ones in the text an error."""
        allowed, refused = self.encoding.policy(allowed_special, disallowed_special)
        ids = self._over(lambda e: lambda x: e.encode_allowed(x, allowed), IDS)(text)
        if not refused:
            return ids
        message = F.concat(F.lit("text holds a special token that isn't allowed: "), text)
        return F.when(self.holds_special(text, refused), F.raise_error(message).cast(IDS)).otherwise(ids)

    def holds_special(self, text: Column, specials=None) -> Column:
        """Whether any of the special strings (all, unless named) is in the text."""
        found = F.lit(False)
        for special in sorted(self.encoding.special_tokens_set if specials is None else specials):
            found = found | F.contains(text, F.lit(special))
        return found

    def count(self, text: Column, with_special: bool = False) -> Column:
        """Number of ids; no id leaves the worker."""
        if self.encoding.nfc:
            text_of = lambda e: e.prepare
        else:
            text_of = lambda e: lambda x: x
        if with_special:
            return self._over(lambda e: (lambda p: lambda x: len(e.encode_with_special(p(x))))(text_of(e)), T.IntegerType())(text)
        return self._over(lambda e: (lambda p: lambda x: e.count(p(x)))(text_of(e)), T.IntegerType())(text)

    def truncate(self, text: Column, max_tokens: int) -> Column:
        """The prefix of at most so many tokens, with its counts."""
        nfc = self.encoding.nfc

        def of(e: Encoding):
            def cut(x: str) -> dict:
                t = e.truncate(e.prepare(x) if nfc else x, max_tokens)
                return {"text": t.text, "bytes": t.bytes, "total_tokens": t.total_tokens, "kept_tokens": t.kept_tokens}

            return cut

        sent = self._sent

        def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            each, names = of(_encoding(sent)), TRUNCATED.names
            for batch in batches:
                yield pd.DataFrame([dict.fromkeys(names) if x is None else each(x) for x in batch], columns=names)

        return F.when(text.isNotNull(), F.pandas_udf(run, TRUNCATED)(text))

    def spans(self, text: Column, unit: str = "byte") -> Column:
        """(start, end) of each id's part of the text."""
        if unit not in ("byte", "char"):
            raise ValueError("unit is 'byte' or 'char'")
        # Plain numbers cross from Python; the pairs are made in Catalyst.
        bounds = self._over(lambda e: lambda x: e.bounds(x, unit), IDS)(text)
        most = F.greatest(F.size(bounds) - 1, F.lit(0))
        pair = lambda a, b: F.struct(a.alias("start"), b.alias("end"))
        return F.zip_with(F.slice(bounds, F.lit(1), most), F.slice(bounds, F.lit(2), most), pair)

    # decoding

    def decode_bytes(self, ids: Column) -> Column:
        return self._over(lambda e: lambda x: e.decode_bytes(x), T.BinaryType())(ids)

    def decode(self, ids: Column, errors: str = "replace") -> Column:
        """Text of ids; the UTF-8 policy is Catalyst's own."""
        raw = self.decode_bytes(ids).cast("string")
        if errors == "strict":
            return F.validate_utf8(raw)
        text = F.make_valid_utf8(raw)
        return F.replace(text, F.lit("�"), F.lit("")) if errors == "ignore" else text

    # tables: joins with these are broadcast, for a vocabulary is bounded by its format

    def vocabulary(self) -> DataFrame:
        return self.encoding.vocabulary.frame(self.spark)

    def specials(self) -> DataFrame:
        return self.encoding.vocabulary.specials_frame(self.spark)

    def every_token(self) -> DataFrame:
        """token_id, token, is_special of the base vocabulary and the special tokens."""
        base = self.vocabulary().select("token_id", "token", F.lit(False).alias("is_special"))
        special = self.specials().select("token_id", F.col("special").cast("binary").alias("token"), F.lit(True).alias("is_special"))
        return base.unionByName(special)

    def lookup(self, rows: DataFrame, token: str) -> DataFrame:
        """Rows with the id of a binary token column, base tokens before special ones; null if unknown."""
        known = self.every_token().groupBy(F.col("token").alias("_token")).agg(
            F.min_by("token_id", F.struct("is_special", "token_id")).alias("token_id")
        )
        return rows.join(F.broadcast(known), F.col(token) == F.col("_token"), "left").drop("_token")

    def by_id(self) -> DataFrame:
        """The vocabulary as one row: `near` has each token at its id's place, `far`, searched
        one by one, the ids so far out that places up to them would mostly be empty. Of a base
        token and a special one with the same id the base token stands."""
        tokens = {i: s.encode() for i, s in self.encoding.special_of.items()} | self.encoding.tokens
        places = range(min(max(tokens, default=-1) + 1, 2 * len(tokens)))
        far = {i: bytearray(t) for i, t in tokens.items() if i not in places}
        near = [bytearray(tokens[i]) if i in tokens else None for i in places]
        row = self.spark.createDataFrame([(near, far)], "near array<binary>, far map<int, binary>")
        return row.select(F.col("near").cast("array<string>").alias("near"), F.col("far").cast("map<int, string>").alias("far"))

    def decode_rows(self, rows: DataFrame, key: str, ids: str) -> DataFrame:
        """key, data: ids decoded with the vocabulary as a table, unknown ids left out; null ids give null.

        Each row meets the whole vocabulary, which is one row, and its ids find their tokens
        there: no id becomes a row, nothing is shuffled or gathered, and rows that share a
        key (or have none) stay apart.
        """
        near, far = (self.by_id().select(part).scalar().alias(part) for part in ("near", "far"))
        # Catalyst takes no subquery in a lambda as written, so both get names first. Each is
        # used once, so the two selections become one and the vocabulary is no part of any row.
        met = rows.select(F.col(key).alias("key"), F.col(ids).alias("ids"), near, far)
        place = lambda i: i.try_cast("int")  # noqa: E731  an id beyond int is none's
        token = lambda i: F.coalesce(F.get("near", place(i)), F.element_at("far", place(i)))
        # Strings here are any bytes; joining them drops the nulls of unknown ids.
        data = F.array_join(F.transform("ids", token), "").cast("binary")
        return met.select(F.col("key").alias(key), data.alias("data"))

    def facts(self) -> DataFrame:
        """n_vocab, max_token_value, eot_token as one row."""
        every = self.every_token()
        eot = F.max(F.when(F.col("is_special") & (F.col("token") == F.lit("<|endoftext|>").cast("binary")), F.col("token_id")))
        return every.agg(
            (F.max("token_id") + 1).alias("n_vocab"), F.max("token_id").alias("max_token_value"), eot.alias("eot_token")
        )

    def memory(self) -> DataFrame:
        """part, bytes of the encoding's tables."""
        return self.spark.createDataFrame(list(self.encoding.memory_breakdown().items()), "part string, bytes long")

    def register(self, prefix: str = "") -> None:
        """SQL functions <prefix>count_tokens, encode_tokens, decode_tokens."""
        sent = self._sent

        def over(of, kind):
            def run(batch: pd.Series) -> pd.Series:
                each = of(_encoding(sent))
                return pd.Series([None if x is None else each(x) for x in batch], dtype=object)

            return F.pandas_udf(run, kind)

        functions = {
            "count_tokens": over(lambda e: lambda x: e.count(e.prepare(x)), T.IntegerType()),
            "encode_tokens": over(lambda e: e.encode_ordinary, IDS),
            "decode_tokens": over(lambda e: e.decode, T.StringType()),
        }
        for name, function in functions.items():
            self.spark.udf.register(prefix + name, function)


def prompt_count(columns: Columns, text: Column) -> Column:
    """Tokens of an embedding prompt: 2 more than a text that names its task or title,
    else 8 more than the text after a space."""
    named = F.startswith(text, F.lit("title: ")) | F.startswith(text, F.lit("task: "))
    # One call: a condition around two would evaluate both.
    counted = columns.count(F.when(named, text).otherwise(F.concat(F.lit(" "), text)))
    return counted + F.when(named, 2).otherwise(8)
