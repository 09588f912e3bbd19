"""The operators as queries over the shared tables, with their SQL twins."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.common import join_on
from . import bpe, ctw, exact, jaccard, kdtree, language, leaks, lines, merkle, packing, warc, whitening, wordpiece
from .batches import fold

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")


_SHIPPED: set[str] = set()


#: Rows of an Arrow batch. Spark's default of 10,000 whole texts takes too much memory beside the heap.
BATCH_ROWS = 1000


def ship(spark: SparkSession) -> None:
    """Prepare a session: batches of few rows, and this package sent to the executors once for an application."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(), "tablewright.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    source = os.path.join(folder, name)
                    out.write(source, os.path.relpath(source, os.path.dirname(package)))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


def query(name: str, sql: str | None = None):
    def add(fn):
        @wraps(fn)
        def run(spark: SparkSession, sf: str) -> DataFrame:
            ship(spark)
            return fn(spark, sf)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query(
    "op1_exact_duplicates",
    r"""with t as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as same, length(coalesce(text, '')) as n from documents)
 select doc_id, first_value(doc_id) over w as keep_id, count(*) over (partition by same) as group_size,
  doc_id = first_value(doc_id) over w as kept, sha256(same) as text_sha256
 from t window w as (partition by same order by n desc, doc_id)""",
)
def _(spark, sf):
    return exact.exact_duplicates(table(spark, sf, "documents"))


@query("op2_context_tree")
def _(spark, sf):
    docs = table(spark, sf, "documents")
    held_out = fold("doc_id", 5) == 1
    model = ctw.fit(docs.where(~held_out))
    scored = ctw.score(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


@query(
    "op3_kdtree_top_k",
    """with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0
   and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
 p as (select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::bigint as score
  from v q join v c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id and len(q.v) = len(c.v))
 select query_id, rank::int as rank, vec_id, score
 from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from p) where rank <= 5""",
)
def _(spark, sf):
    return kdtree.top_k(table(spark, sf, "embeddings"), F.col("vec_id") % 50 == 0, 5)


@query(
    "op4_warc_index",
    """with p as (select page_id, coalesce(html, '') as html, max(page_id) over (partition by coalesce(html, '')) as keeper from pages)
 select page_id, strlen(html)::bigint as payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
   1 + ((('0x' || substr(sha1(html), (1 + 5 * (i // 4))::int, 5))::bigint >> (15 - 5 * (i % 4))) & 31)::int, 1)), '') as payload_digest,
  case when page_id = keeper then 'response' else 'revisit' end as record_type,
  case when page_id <> keeper then keeper end as refers_to
 from p""",
)
def _(spark, sf):
    index = warc.archived(table(spark, sf, "pages"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op5_language")
def _(spark, sf):
    docs = table(spark, sf, "documents")
    held_out = fold("doc_id", 4) == 2
    model = language.fit(docs.where(~held_out))
    told = language.identify(docs.select("doc_id", "text"), model)
    return told.select("doc_id", held_out.alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"))


@query("op6_byte_bpe")
def _(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    ids = bpe.encode(docs, BYTE_RANKS, public_tokenizers.PATTERN).drop("text")
    both = bpe.decode(ids, BYTE_RANKS)
    listed = F.array_join(F.col("ids").cast("array<string>"), " ")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query(
    "op7_jaccard_join",
    r"""with recursive w as (select doc_id, string_split_regex(trim(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13),
   'abcdefghijklmnopqrstuvwxyz' || repeat(' ', 5)), ' '), ' +') as w from documents),
 g as (select doc_id, case when w = [''] then []::varchar[] when len(w) < 5 then [array_to_string(w, ' ')]
   else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end as g from w),
 s as (select doc_id, hash(unnest(g)) as s from g),
 n as (select doc_id, len(g) as n from g),
 o as (select a.doc_id as a, b.doc_id as b, count(*) as o from s a join s b on a.s = b.s and a.doc_id <> b.doc_id group by all),
 e as (select a, b from o join n x on x.doc_id = a join n y on y.doc_id = b where 100 * o >= 75 * (x.n + y.n - o)),
 r as (select doc_id as node, doc_id as seen from n union select r.node, e.b from r join e on e.a = r.seen)
 select n.doc_id, n.n as n_shingles, min(r.seen) as component_id from n join r on r.node = n.doc_id group by n.doc_id, n.n""",
)
def _(spark, sf):
    return jaccard.jaccard_components(table(spark, sf, "documents")).select("doc_id", "n_shingles", "component_id")


@query("op8_packing")
def _(spark, sf):
    pieces = packing.packed(table(spark, sf, "documents"), WORD_VOCABULARY, 2)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("op9_token_counts")
def _(spark, sf):
    return wordpiece.token_counts(table(spark, sf, "documents"), PIECE_MODEL)


def _listed(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


@query("op10_secrets")
def _(spark, sf):
    found = leaks.secret_spans(table(spark, sf, "documents").select("doc_id", "text"), BYTE_RANKS, public_tokenizers.PATTERN)

    def number(kind):
        return F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s.kind.isin("assign", "access", "hex"))
    return found.select("doc_id", number("assign"), number("access"), number("hex"), F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))


@query(
    "op11_line_dedup",
    r"""with d as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
 l as (select r, doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from d),
 k as (select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k from l),
 h as (select k, count(distinct r) as docs, max(coalesce(doc_id, -9223372036854775808)) as keeper from k where length(k) >= 20 group by k having count(distinct r) >= 3),
 m as (select k.*, h.k is not null and h.keeper > coalesce(doc_id, -9223372036854775808) as lost from k left join h on k.k = h.k)
 select doc_id, count(*) as n_lines, count(*) filter (lost) as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by i) filter (not lost), '')) as kept_sha256
 from m group by r, doc_id""",
)
def _(spark, sf):
    kept = lines.dedup_lines(table(spark, sf, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query("op12_whitening")
def _(spark, sf):
    return whitening.whitened(table(spark, sf, "embeddings"))


_CRC = """list_reduce(list_concat([4294967295::bigint], list_transform(string_split(coalesce(doc_id::varchar, ''), ''), lambda c: ord(c)::bigint)), lambda x, c:
  list_reduce(list_concat([xor(x, c)], range(8)), lambda y, i: xor(y >> 1, 3988292384 * (y & 1))))"""


@query(
    "op13_merkle_manifest",
    f"""with recursive d as (select row_number() over () as r, *, case when doc_id is null or xor({_CRC}, 4294967295) % 3 = 0
    then translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else text end as other from documents),
 f as (select *, coalesce(strlen(doc_id::varchar) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
   || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-') as fields from d),
 h as (select r, doc_id, lang, sha256(fields || coalesce(strlen(text) || ':' || text, '-')) as leaf, sha256(fields || coalesce(strlen(other) || ':' || other, '-')) as tampered from f),
 v as (select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as pos, count(*) over (partition by lang) as n from h),
 t as (select lang, 0 as level, pos, leaf as digest, n from v
  union all select lang, any_value(level) + 1, pos // 8, sha256(string_agg(digest, '' order by pos)), (any_value(n) + 7) // 8 from t where n > 1 group by lang, pos // 8),
 s as (select *, row_number() over (order by lang nulls first) - 1 as place, count(*) over () as langs from t where n = 1),
 u as (select 0 as level, place as pos, digest, langs as n from s
  union all select any_value(level) + 1, pos // 8, sha256(string_agg(digest, '' order by pos)), (any_value(n) + 7) // 8 from u where n > 1 group by pos // 8),
 e as (select v.r, x.level, string_agg(x.digest, '' order by x.pos) filter (x.pos < v.pos // (8 ** x.level)::bigint) as before, string_agg(x.digest, '' order by x.pos) filter (x.pos > v.pos // (8 ** x.level)::bigint) as after
   from (select r, lang, pos::bigint as pos from v) v join t x on v.lang is not distinct from x.lang and x.n > 1 and x.pos // 8 = v.pos // (8 ** (x.level + 1))::bigint group by v.r, x.level
  union all select v.r, 100 + x.level, string_agg(x.digest, '' order by x.pos) filter (x.pos < s.place // (8 ** x.level)::bigint), string_agg(x.digest, '' order by x.pos) filter (x.pos > s.place // (8 ** x.level)::bigint)
   from v join s on v.lang is not distinct from s.lang join u x on x.n > 1 and x.pos // 8 = s.place // (8 ** (x.level + 1))::bigint group by v.r, x.level),
 o as (select *, row_number() over (partition by r order by level) as step from e),
 p as (select r, sha256(string_agg(coalesce(before, '') || coalesce(after, ''), '' order by step)) as proof_sha256 from o group by r),
 w as (select r, 0::bigint as step, tampered as now from v
  union all select w.r, o.step, sha256(coalesce(o.before, '') || w.now || coalesce(o.after, '')) from w join o on o.r = w.r and o.step = w.step + 1),
 z as (select r, arg_max(now, step) as folded_root from w group by r)
 select v.doc_id, v.leaf, s.digest as subroot, u.digest as root, coalesce(p.proof_sha256, sha256('')) as proof_sha256, z.folded_root, z.folded_root = u.digest as verified
 from v join s on v.lang is not distinct from s.lang join u on u.n = 1 left join p on p.r = v.r join z on z.r = v.r""",
)
def _(spark, sf):
    docs = table(spark, sf, "documents")
    fields = ("doc_id", "source", "lang", "n_chars")
    altered = F.when(fold("doc_id", 3) == 0, merkle.lowered(F.col("text"))).otherwise(F.col("text"))
    tampered = merkle.leaf_digest([*map(F.col, fields), altered])
    told = merkle.build(docs, [*fields, "text"], carry={"doc_id": F.col("doc_id"), "tampered": tampered})
    proved = merkle.proofs(told, told.leaves)
    subroots = told.trees.select("tree", F.col("digest").alias("subroot"))
    return join_on(proved, subroots, ["tree"]).select(
        "doc_id",
        F.col("found").alias("leaf"),
        "subroot",
        F.lit(told.root).cast("string").alias("root"),
        merkle.proof_digest(F.col("proof")).alias("proof_sha256"),
        merkle.folded(F.col("proof"), F.col("tampered")).alias("folded_root"),
        (merkle.folded(F.col("proof"), F.col("tampered")) == F.lit(told.root)).alias("verified"),
    )
