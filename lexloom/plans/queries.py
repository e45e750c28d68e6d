"""The registered queries of the engine, each with its DuckDB twin where SQL can say it.

All run over whole tables and whole texts. Results are long rows or scalars, so that any
engine can compare them.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexloom.functions import grammar
from lexloom.functions.columns import Columns, prompt_count, spread
from lexloom.operators import estimate
from lexloom.operators.registry import Encoding, load
from lexloom.plans import oracle
from lexloom.sources import formats
from lexloom.streaming import count_stream

TRUNCATE_AT = 64
SPECIALS = [("<|endoftext|>", 50256), ("<|im_start|>", 50257), ("<|im_end|>", 50258)]

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def _place(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache
def _ranked(grammar_name: str = "cl100k") -> Encoding:
    """The public rank vocabulary under one of the grammars, with special tokens."""
    vocabulary = formats.read_vocabulary(_place("byte_bpe_50k.tiktoken"))
    vocabulary.specials = list(SPECIALS)
    return Encoding(f"byte_bpe_50k/{grammar_name}", vocabulary, grammar_name)


def _columns(spark: SparkSession, grammar_name: str = "cl100k") -> Columns:
    return Columns(spark, _ranked(grammar_name))


def _docs(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select(*(columns or ("doc_id", "text"))))


def query(sql: str | None = None):
    """Register a function by its name, with its SQL."""

    def keep(function: Query) -> Query:
        _QUERIES[function.__name__] = function
        if sql:
            _ORACLES[function.__name__] = sql
        return function

    return keep


def _merged(select: str, texts: str = "select doc_id as key, text from documents", name: str = "cl100k") -> str:
    return oracle.with_merged(texts, name, _place("byte_bpe_50k.tiktoken"), select)


# splitting


def _split_query(name: str, table: str, key: str, text: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = spread(spark.read.parquet(f"{sf_dir}/{table}.parquet").select(key, text))
        each = rows.select(key, F.posexplode(grammar.pieces(F.col(text), name)).alias("pos", "piece"))
        return each.select(key, F.col("pos").cast("long").alias("pos"), "piece")

    run.__name__ = f"pretok_{name}" if table == "documents" else f"pretok_{name}_{table}"
    sql = f"""select {key}, unnest(range(0, len(ps))) as pos, unnest(ps) as piece
        from (select {key}, {oracle.split(name, text)} as ps from {table})"""
    query(sql)(run)


for _name in ("cl100k", "o200k", "qwen", "qwen_marks"):
    _split_query(_name, "documents", "doc_id", "text")
_split_query("cl100k", "pages", "page_id", "html")


@query("select doc_id, replace(text || '▁x', '▁', ' ') as folded from documents")
def fold_marker(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat("text", F.lit("▁x"))
    return _docs(spark, sf_dir).select("doc_id", grammar.fold_marker(text).alias("folded"))


# counting and encoding


@query(_merged("select s.key as doc_id, count(t.n) as n_tokens from src s left join toks t using (key) group by 1"))
def count_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = _columns(spark).count(F.col("text")).cast("long")
    return _docs(spark, sf_dir).select("doc_id", count.alias("n_tokens"))


@query(
    _merged(
        """select d.lang, count(*) as n_docs, cast(sum(c.k) as bigint) as n_tokens, max(c.k) as most
        from documents d join (select s.key, count(t.n) as k from src s left join toks t using (key) group by 1) c
        on c.key = d.doc_id group by 1"""
    )
)
def count_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = _docs(spark, sf_dir, "lang", "text").select("lang", _columns(spark).count(F.col("text")).cast("long").alias("k"))
    return counted.groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum("k").alias("n_tokens"), F.max("k").alias("most"))


@query(
    _merged(
        "select s.key as doc_id, count(t.n) as n_tokens from src s left join toks t using (key) group by 1", name="o200k"
    )
)
def count_tokens_o200k(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = _columns(spark, "o200k").count(F.col("text")).cast("long")
    return _docs(spark, sf_dir).select("doc_id", count.alias("n_tokens"))


@query(_merged("select key as doc_id, n - 1 as pos, r as token_id from toks"))
def encode_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = _docs(spark, sf_dir).select("doc_id", F.posexplode(_columns(spark).encode(F.col("text"))).alias("pos", "token_id"))
    return ids.select("doc_id", F.col("pos").cast("long").alias("pos"), F.col("token_id").cast("long").alias("token_id"))


@query(
    _merged(
        """select s.key as doc_id, count(t.n) as n_tokens,
        cast(coalesce(sum(t.n * t.r), 0) as bigint) as weighted from src s left join toks t using (key) group by 1"""
    )
)
def encode_batch_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ragged batch of ids, by a digest that depends on every id and its place."""
    ids = _docs(spark, sf_dir).select("doc_id", _columns(spark).encode(F.col("text")).alias("ids"))
    place = F.aggregate(
        F.transform("ids", lambda x, i: (i + 1).cast("long") * x), F.lit(0).cast("long"), lambda a, x: a + x
    )
    return ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), place.alias("weighted"))


@query(
    _merged(
        """select key as doc_id, n - 1 as pos, cast(sum(octet_length(unhex(h))) over w - octet_length(unhex(h)) as bigint) as start_byte,
        cast(sum(octet_length(unhex(h))) over w as bigint) as end_byte from toks window w as (partition by key order by n)"""
    )
)
def offsets_byte(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spans(spark, sf_dir, "byte")


@query(
    _merged(
        """select key as doc_id, n - 1 as pos, cast(sum(c) over w - c as bigint) as start_char, cast(sum(c) over w as bigint) as end_char
        from (select key, n, len(list_filter(range(0, octet_length(unhex(h))),
            lambda i: h[2 * i + 1 : 2 * i + 1] not in ('8', '9', 'a', 'b'))) as c from toks)
        window w as (partition by key order by n)"""
    )
)
def offsets_char(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spans(spark, sf_dir, "char")


def _spans(spark: SparkSession, sf_dir: str, unit: str) -> DataFrame:
    spans = _columns(spark).spans(F.col("text"), unit)
    each = _docs(spark, sf_dir).select("doc_id", F.posexplode(spans).alias("pos", "span"))
    start, end = (F.col(f"span.{side}").cast("long").alias(f"{side}_{unit}") for side in ("start", "end"))
    return each.select("doc_id", F.col("pos").cast("long").alias("pos"), start, end)


# decoding


@query("select doc_id, text as decoded from documents")
def decode_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _columns(spark)
    ids = _docs(spark, sf_dir).select("doc_id", c.encode(F.col("text")).alias("ids"))
    return ids.select("doc_id", c.decode(F.col("ids")).alias("decoded"))


@query("select doc_id, text as decoded from documents")
def decode_join_unknown_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoding with the vocabulary as a table; an id beyond it, put before each text, says nothing."""
    c = _columns(spark)
    ids = _docs(spark, sf_dir).select(
        "doc_id", F.concat(F.array(F.lit(250_000)), c.encode(F.col("text"))).alias("ids")
    )
    decoded = c.decode_rows(ids, "doc_id", "ids")
    return decoded.select("doc_id", F.make_valid_utf8(F.col("data").cast("string")).alias("decoded"))


@query("select doc_id, cast(length(text) as bigint) as ignored, cast(length(text) + 1 as bigint) as replaced from documents")
def decode_error_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lone lead byte before each text: dropped, or one replacement character."""
    c = _columns(spark)
    lead = c.encoding.ids[b"\xc3"]
    ids = _docs(spark, sf_dir).filter("text is not null").select(
        "doc_id", F.concat(F.array(F.lit(lead)), c.encode(F.col("text"))).alias("ids")
    )
    sizes = [F.char_length(c.decode(F.col("ids"), e)).cast("long") for e in ("ignore", "replace")]
    return ids.select("doc_id", sizes[0].alias("ignored"), sizes[1].alias("replaced"))


# truncation


def _truncate_sql(most: int) -> str:
    return _merged(
        f"""select s.key as doc_id, count(t.n) as total_tokens,
        cast(coalesce(sum(octet_length(unhex(t.h))) filter (where t.n <= {most}), 0) as bigint)
          - (case when coalesce(min(c.tail), 0) > 0 then min(c.tail) else 0 end) as kept_bytes
        from src s left join toks t using (key) left join cut c using (key) group by 1""".replace(
            "from src", "from src", 1
        )
    ).replace(
        "select s.key as doc_id",
        f""", head as (select key, string_agg(h, '' order by n) as hx from toks where n <= {most} group by key),
        rest as (select key, h from toks where n = {most} + 1),
        cut as (select head.key, case when rest.h is null or rest.h[1:1] not in ('8', '9', 'a', 'b') then 0
            else length(regexp_extract(hx, '(?:[c-f].|$)(?:[89ab].)*$')) // 2 end as tail
            from head left join rest using (key))
        select s.key as doc_id""",
        1,
    )


@query(_truncate_sql(TRUNCATE_AT))
def truncate_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _truncated(spark, sf_dir, TRUNCATE_AT)


@query(
    _merged("select s.key as doc_id, count(t.n) as total_tokens, 0::bigint as kept_bytes from src s left join toks t using (key) group by 1")
)
def truncate_to_nothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _truncated(spark, sf_dir, 0)


def _truncated(spark: SparkSession, sf_dir: str, most: int) -> DataFrame:
    cut = _docs(spark, sf_dir).select("doc_id", _columns(spark).truncate(F.col("text"), most).alias("t"))
    return cut.select(
        "doc_id", F.col("t.total_tokens").cast("long").alias("total_tokens"), F.col("t.bytes").cast("long").alias("kept_bytes")
    )


_ENDS = "select key, n, cast(sum(octet_length(unhex(h))) over (partition by key order by n) as bigint) as ending from toks"


@query(
    _merged(
        f"""select s.key as doc_id, cast(count(e.n) filter (where e.n <= {TRUNCATE_AT} and (e.ending <= b.kept)) as bigint) as kept_tokens
        from src s left join ({_ENDS}) e using (key) left join (
            select key, octet_length(encode(text)) as size, coalesce(max(ending) filter (where n <= {TRUNCATE_AT}), 0) as stop,
                -- the last border of characters up to the cut
                coalesce((select max(x) from unnest(range(greatest(0, stop - 3), stop + 1)) u(x)
                    where x = size or x = 0 or hex(encode(text))[2 * x + 1 : 2 * x + 1] not in ('8', '9', 'A', 'B')), 0) as kept
            from src left join ({_ENDS}) using (key) group by key, text) b using (key) group by 1"""
    )
)
def truncate_kept_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many whole tokens the kept prefix holds."""
    cut = _docs(spark, sf_dir).select("doc_id", _columns(spark).truncate(F.col("text"), TRUNCATE_AT).alias("t"))
    return cut.select("doc_id", F.coalesce("t.kept_tokens", F.lit(0)).cast("long").alias("kept_tokens"))


# special tokens

_MARKED = "'<|im_start|>' || text || '<|im_end|><|endoftext|>'"


@query(_merged("select s.key as doc_id, 3 + count(t.n) as n_tokens from src s left join toks t using (key) group by 1"))
def count_with_specials(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = F.concat(F.lit("<|im_start|>"), "text", F.lit("<|im_end|><|endoftext|>"))
    count = _columns(spark).count(marked, with_special=True).cast("long")
    return _docs(spark, sf_dir).select("doc_id", count.alias("n_tokens"))


@query(
    _merged(
        "select s.key as doc_id, count(t.n) as n_tokens from src s left join toks t using (key) group by 1",
        f"select doc_id as key, {_MARKED} as text from documents",
    )
)
def specials_as_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = F.concat(F.lit("<|im_start|>"), "text", F.lit("<|im_end|><|endoftext|>"))
    return _docs(spark, sf_dir).select("doc_id", _columns(spark).count(marked).cast("long").alias("n_tokens"))


@query(
    """select doc_id, contains(t, '<|endoftext|>') or contains(t, '<|im_start|>') or contains(t, '<|im_end|>') as refused
    from (select doc_id, case when doc_id % 2 = 0 then text else text || '<|im_end|>' end as t from documents)"""
)
def refused_specials(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise(F.concat("text", F.lit("<|im_end|>")))
    return _docs(spark, sf_dir).select("doc_id", _columns(spark).holds_special(text).alias("refused"))


@query(
    _merged(
        "select s.key as doc_id, 2 + count(t.n) as n_tokens from src s left join toks t using (key) group by 1",
        "select doc_id as key, text || '<|im_end|>' as text from documents",
    )
)
def special_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two of three specials are allowed; the third, refused by nobody, is ordinary text."""
    marked = F.concat(F.lit("<|im_start|>"), "text", F.lit("<|im_end|><|endoftext|>"))
    ids = _columns(spark).encode_special(marked, {"<|im_start|>", "<|endoftext|>"})
    return _docs(spark, sf_dir).select("doc_id", F.size(ids).cast("long").alias("n_tokens"))


@query("select doc_id, text as decoded from documents")
def decode_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of whole texts are UTF-8, so the strict policy lets all of them pass."""
    c = _columns(spark)
    ids = _docs(spark, sf_dir).select("doc_id", c.encode(F.col("text")).alias("ids"))
    return ids.select("doc_id", c.decode(F.col("ids"), "strict").alias("decoded"))


# the vocabulary as tables

_VOCAB = f"""select r as token_id, from_base64(b) as token from read_csv('{_place("byte_bpe_50k.tiktoken")}', delim=' ',
    header=false, quote='', escape='', columns={{'b': 'VARCHAR', 'r': 'BIGINT'}})"""
_SPECIAL = " union all ".join(f"select {i} as token_id, '{s}' as special" for s, i in SPECIALS)


@query(f"select token_id, lower(hex(token)) as token_hex, cast(octet_length(token) as bigint) as n_bytes from ({_VOCAB})")
def vocabulary_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _columns(spark).vocabulary()
    return v.select(
        F.col("token_id").cast("long").alias("token_id"),
        F.lower(F.hex("token")).alias("token_hex"),
        F.col("n_bytes").cast("long").alias("n_bytes"),
    )


@query(
    f"""select max(token_id) + 1 as n_vocab, max(token_id) as max_token_value,
    max(token_id) filter (where special = '<|endoftext|>') as eot_token
    from (select token_id, '' as special from ({_VOCAB}) union all select token_id, special from ({_SPECIAL}))"""
)
def vocabulary_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _columns(spark).facts().select(*(F.col(c).cast("long").alias(c) for c in ("n_vocab", "max_token_value", "eot_token")))


@query(
    f"""select w.word, cast(coalesce(v.token_id, p.token_id, -1) as bigint) as token_id
    from (select distinct unnest(string_split(text, ' ')) as word from documents union select '<|im_end|>') w
    left join ({_VOCAB}) v on v.token = encode(w.word) left join ({_SPECIAL}) p on p.special = w.word"""
)
def single_token_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _docs(spark, sf_dir).select(F.explode(F.split("text", " ")).alias("word"))
    words = words.unionByName(spark.range(1).select(F.lit("<|im_end|>").alias("word"))).distinct()
    found = _columns(spark).lookup(words.withColumn("token", F.col("word").cast("binary")), "token")
    return found.select("word", F.coalesce("token_id", F.lit(-1)).cast("long").alias("token_id"))


@query(
    f"""select token_id, lower(hex(token)) as token_hex, false as is_special from ({_VOCAB})
    union all select token_id, lower(hex(encode(special))), true from ({_SPECIAL})"""
)
def token_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bytes of every id, ordinary and special."""
    return _columns(spark).every_token().select(
        F.col("token_id").cast("long").alias("token_id"), F.lower(F.hex("token")).alias("token_hex"), "is_special"
    )


@query(f"select i.range as token_id, p.special is not null as is_special from range(50000, 50300) i left join ({_SPECIAL}) p on p.token_id = i.range")
def is_special(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = spark.range(50_000, 50_300).withColumnRenamed("id", "token_id")
    specials = F.broadcast(_columns(spark).specials())
    return ids.join(specials, "token_id", "left").select("token_id", F.col("special").isNotNull().alias("is_special"))


@query(
    f"""select 'tokens' as part, cast(sum(octet_length(token) + 4) as bigint) as bytes from ({_VOCAB})
    union all select 'specials', cast(sum(octet_length(encode(special)) + 6) as bigint) from ({_SPECIAL})
    union all select unnest(['splits', 'merges', 'pairs']), 0"""
)
def memory_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _columns(spark).memory()


# normalization

_ACCENT = "replace(text, 'e', 'e' || chr(769))"


@query(f"""select doc_id, nfc_normalize(t) <> t as changed
    from (select doc_id, case when doc_id % 2 = 0 then {_ACCENT} else text end as t from documents)""")
def nfc_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second text has its e accented in two code points; the others are composed."""
    accented = F.replace(F.col("text"), F.lit("e"), F.lit("e\u0301"))
    text = F.when(F.col("doc_id") % 2 == 0, accented).otherwise(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", _columns(spark).unnormalized(text).alias("changed"))


@query(
    _merged(
        "select s.key as doc_id, count(t.n) as n_tokens from src s left join toks t using (key) group by 1",
        f"select doc_id as key, nfc_normalize({_ACCENT}) as text from documents",
        "qwen",
    )
)
def nfc_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = _ranked("qwen")
    c = Columns(spark, Encoding("byte_bpe_50k/qwen+nfc", plain.vocabulary, "qwen", nfc=True))
    text = F.replace(F.col("text"), F.lit("e"), F.lit("e\u0301"))
    return _docs(spark, sf_dir).select("doc_id", c.count(text).cast("long").alias("n_tokens"))


# bytes, character vocabularies, prompts


@query()
def encode_bytes_invalid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts after a stray byte: ids decode to the same bytes."""
    c = _columns(spark)
    data = F.concat(F.lit(b"\xff\xc3"), F.col("text").cast("binary"))
    ids = _docs(spark, sf_dir).select("doc_id", data.alias("data"), c.encode_bytes(data).alias("ids"))
    same = c.decode_bytes(F.col("ids")) == F.col("data")
    return ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), same.alias("same"))


@query(_merged("select s.key as doc_id, count(t.n) as n_tokens from src s left join toks t using (key) group by 1"))
def encode_by_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same vocabulary from its merge list: pairs in list order make the same tokens."""
    encoding = load("byte_bpe_50k/pairs", _place("byte_bpe_50k.json"), "cl100k")
    return _docs(spark, sf_dir).select("doc_id", Columns(spark, encoding).count(F.col("text")).cast("long").alias("n_tokens"))


@query(
    _merged(
        """select s.key as doc_id, count(t.n) + case when s.key % 2 = 0 then 2 else 8 end as n_tokens
        from src s left join toks t using (key) group by 1, s.key""",
        "select doc_id as key, case when doc_id % 2 = 0 then 'title: ' else ' ' end || text as text from documents",
    )
)
def prompt_wrapped_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("title: "), "text")).otherwise(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", prompt_count(_columns(spark), text).cast("long").alias("n_tokens"))


# the estimate


_RUNS = "|".join(c + "{9}" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
_SCRIPT = " ".join(
    rf"when regexp_matches(first, '[\x{{{low:X}}}-\x{{{high:X}}}]') then '{name}'" for low, high, name in estimate.SCRIPTS
)
_SCRIPTS = "".join(rf"\x{{{low:X}}}-\x{{{high:X}}}" for low, high, _ in estimate.SCRIPTS)
_CLASS = rf"""case when regexp_full_match(piece, '[{oracle.SPACE}]+')
        then case when regexp_matches(piece, '[\r\n]') then 'newline' else 'space' end
    when regexp_full_match(piece, '\p{{N}}') then 'digit'
    when regexp_matches(piece, '[\x{{10000}}-\x{{10FFFF}}]') then 'astral'
    when not regexp_matches(piece, '\p{{L}}') then 'punct'
    when piece[1] = chr(39) and length(piece) <= 3 then 'contr'
    {_SCRIPT}
    when regexp_matches(piece, '{_RUNS}') then 'run'
    when regexp_matches(piece, '[^\x00-\x7F]') then 'latinx'
    when not regexp_matches(piece, '[A-Z]') then 'lower'
    when not regexp_matches(piece, '[a-z]') then case when regexp_matches(piece, '[A-Z][^A-Z]*[A-Z]') then 'upper' else 'cap' end
    when regexp_full_match(piece, '[^A-Za-z]*[A-Z][^A-Z]*') then 'cap' else 'camel' end"""


def _listed(names: list[str]) -> str:
    return ", ".join(f"'{n}'" for n in names)


def _features_sql(select: str) -> str:
    """With counters(key, class, n): the counters of each text that aren't 0."""
    ctes = rf""", classed as (
        select piece, sym, {_CLASS} as class from (select *, regexp_extract(piece, '[{_SCRIPTS}]') as first from coded)
    ), sized as materialized (
        select c.piece, c.class, case when c.class in ({_listed(estimate.BY_TOKEN)}) then len(c.sym) else length(c.piece) end as size,
            case when c.class in ({_listed(estimate.WITH_RARE)}) then coalesce(r.k, 0) else 0 end as rare
        from classed c left join (select piece, count(*) as k from (select piece, unnest(sym) as h from coded)
            join vocab using (h) where r >= {estimate.RARE_ID} group by piece) r using (piece)
    ), counters as materialized (
        select key, class, cast(sum(size) as bigint) as n from pieces join sized using (piece) group by 1, 2 having sum(size) > 0
        union all select key, 'rare_' || class, cast(sum(rare) as bigint) from pieces join sized using (piece)
            group by 1, 2 having sum(rare) > 0
        union all select key, 'const', 1 from src where text <> ''
    ) """
    return _merged(f"{ctes} {select}", name="qwen")


_COST_ROWS = ", ".join(f"({k}, '{c}', {cost!r}::double)" for k, (c, cost) in enumerate(zip(estimate.CLASSES, estimate.COSTS)))


@query(_features_sql("select key as doc_id, class, n from counters"))
def estimate_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    counters = estimate.features(_columns(spark), F.col("text"))
    each = _docs(spark, sf_dir).select("doc_id", F.posexplode(counters).alias("at", "n")).filter("n > 0")
    names = F.array(*map(F.lit, estimate.CLASSES))
    return each.select("doc_id", F.element_at(names, F.col("at") + 1).alias("class"), F.col("n").cast("long").alias("n"))


@query(
    _features_sql(
        f"""select s.key as doc_id, cast(ceil(coalesce(any_value(t.total), 0)) as bigint) as at_most from src s left join (
            select key, list_reduce(list(n * cost order by place), lambda a, b: a + b) as total
            from counters join (values {_COST_ROWS}) c(place, class, cost) using (class) group by key) t using (key) group by s.key"""
    )
)
def estimate_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir).select("doc_id", estimate.features(_columns(spark), F.col("text")).alias("features"))
    return rows.select("doc_id", estimate.estimate(F.col("features")).cast("long").alias("at_most"))


@query()
def estimate_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = _docs(spark, sf_dir).select("doc_id", estimate.truncated(_columns(spark), F.col("text"), 200).alias("t"))
    return cut.select(
        "doc_id",
        F.octet_length("t.text").cast("long").alias("kept_bytes"),
        F.col("t.total").cast("long").alias("total"),
        F.col("t.kept").cast("long").alias("estimate"),
    )


_CLASS_SQL = f"""select piece, {_CLASS} as class
    from (select piece, regexp_extract(piece, '[{_SCRIPTS}]') as first from (
        select distinct unnest({oracle.split("qwen")}) as piece from documents))"""


@query(_CLASS_SQL)
def piece_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of every distinct piece, as a Catalyst expression."""
    each = _docs(spark, sf_dir).select(F.explode(grammar.pieces(F.col("text"), "qwen")).alias("piece")).distinct()
    return each.select("piece", estimate.classify(F.col("piece")).alias("class"))


# other tables and streams


@query(
    _merged(
        """select c.conv_id, count(*) as n_turns, cast(sum(k.k) as bigint) as n_tokens from conversations c
        join (select s.key, count(t.n) as k from src s left join toks t using (key) group by 1) k
        on k.key = c.conv_id * 100000 + c.turn group by 1""",
        "select conv_id * 100000 + turn as key, text from conversations",
    )
)
def conversation_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "text"))
    counted = rows.select("conv_id", _columns(spark).count(F.col("text")).cast("long").alias("k"))
    return counted.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.sum("k").alias("n_tokens"))


@query(
    _merged(
        "select s.key as page_id, count(t.n) as n_tokens from src s left join toks t using (key) group by 1",
        "select page_id as key, html as text from pages",
    )
)
def page_html_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spread(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html"))
    return pages.select("page_id", _columns(spark).count(F.col("html")).cast("long").alias("n_tokens"))


@query(_merged("select s.key as doc_id, count(t.n) as n_tokens from src s left join toks t using (key) group by 1"))
def stream_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents read as a stream, counted by the same column."""
    return count_stream.counted(spark, sf_dir, _columns(spark))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
