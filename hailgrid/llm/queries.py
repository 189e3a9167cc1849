"""Registered queries: each operator on its whole table, and their SQL where it can be written."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hailgrid.llm.curve_neighbours import neighbours
from hailgrid.llm.decontaminate import contamination
from hailgrid.llm.language_id import fit_languages, identify_languages
from hailgrid.llm.license_scan import license_spans
from hailgrid.llm.multi_index import near_vectors
from hailgrid.llm.near_dedup import near_duplicates
from hailgrid.llm.packing import pack
from hailgrid.llm.periodic_runs import periodic_runs, planted
from hailgrid.llm.quality import fit_quality, score_quality
from hailgrid.llm.ranked_search import build_index, search
from hailgrid.llm.repeats import repeated_spans
from hailgrid.llm.token_counts import token_counts
from hailgrid.llm.toxicity import ToxicityModel, fit_toxicity, score_toxicity


def tokenizer_path(name: str) -> str:
    """A vocabulary file of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of ``documents`` by four-word shingles."""
    found = near_duplicates(_table(spark, sf_dir, "documents"), shingle_words=4, percent=80)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License texts and notices in ``documents``."""
    return license_spans(_table(spark, sf_dir, "documents"))


def op3_curve_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest found of each vector of ``embeddings`` whose id is divisible by 50."""
    return neighbours(_table(spark, sf_dir, "embeddings"), k=5, every=50)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of ``documents`` inside ten-word windows of ``benchmark``."""
    found = contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), window=10)
    names = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(names.cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of ``documents`` covered by strings of 200 bytes that start elsewhere too."""
    found = repeated_spans(_table(spark, sf_dir, "documents"), length=200)
    return found.select(
        "doc_id",
        "n_bytes",
        F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two length of the tokenised ``documents``."""
    pieces = pack(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), limit=1024, end_id=0)
    return pieces.select("doc_id", "start", "length", F.crc32("tokens").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of ``documents``."""
    docs = _table(spark, sf_dir, "documents")
    model = fit_languages(docs.where(part_of("doc_id", 5) != 0).select("doc_id", "text", "lang"), tokenizer_path("byte_bpe_multi_50k.tiktoken"))
    found = identify_languages(docs, model)
    return found.select("doc_id", F.coalesce(part_of("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy longest-match token counts of ``documents``."""
    return token_counts(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"))


def learnable(spark: SparkSession, sf_dir: str, parts: int, held_out: int) -> DataFrame:
    """The rows of ``labels`` that may be learnt from: crc32 of the id, modulo ``parts``, isn't ``held_out``."""
    return _table(spark, sf_dir, "labels").where(part_of("doc_id", parts) != held_out)


def part_of(doc_id: str, parts: int) -> Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(parts))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of ``documents``."""
    docs = _table(spark, sf_dir, "documents")
    model = fit_quality(docs, learnable(spark, sf_dir, 3, 1), metadata=("n_chars",))
    found = score_quality(docs, model)
    return found.select("doc_id", F.coalesce(part_of("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def toxicity_model(spark: SparkSession, sf_dir: str) -> ToxicityModel:
    return fit_toxicity(_table(spark, sf_dir, "documents"), learnable(spark, sf_dir, 4, 2))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of ``documents``."""
    found = score_toxicity(_table(spark, sf_dir, "documents"), toxicity_model(spark, sf_dir))
    return found.select(
        "doc_id", F.coalesce(part_of("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "toxic_windows"
    )


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of the words of ``documents``, every tenth with a period planted in it."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", planted("doc_id", "text").alias("text"))
    first = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("shortness"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    found = periodic_runs(docs).withColumn("longest", first)
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("longest.start").alias("start"),
        (-F.col("longest.shortness")).alias("length"),
        F.col("longest.period").alias("period"),
        F.floor(-1000 * F.col("longest.shortness") / F.col("longest.period")).alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op12_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of ``embeddings`` with equal labels."""
    return near_vectors(_table(spark, sf_dir, "embeddings"), threshold=0.93)


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best ``documents`` for each ``benchmark`` item."""
    return search(build_index(_table(spark, sf_dir, "documents")), _table(spark, sf_dir, "benchmark"), k=10)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of the corpus pipeline on ``documents``."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_dedup": op1_near_dedup,
    "op2_license_scan": op2_license_scan,
    "op3_curve_neighbours": op3_curve_neighbours,
    "op4_decontamination": op4_decontamination,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_language_id": op6_language_id,
    "op7_token_counts": op7_token_counts,
    "op8_quality": op8_quality,
    "op9_packing": op9_packing,
    "op10_toxicity": op10_toxicity,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_embedding_dedup": op12_embedding_dedup,
    "op13_ranked_search": op13_ranked_search,
    "pipeline": pipeline,
}

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL: dict[str, str] = {
    "op1_near_dedup": rf"""with recursive w as (select row_number() over () as r, doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') as words from documents),
      s as materialized (select distinct r, hash(array_to_string(words[i : i + 3], ' ')) as h from (select r, words, unnest(range(1, greatest(len(words) - 2, 2))) as i from w where len(words) > 0)),
      n as materialized (select r, count(*) as n from s group by 1),
      c as (select a.r as a, b.r as b, count(*) as k from s a join s b on a.h = b.h and a.r <> b.r group by all),
      e as materialized (select a, b from c join n x on x.r = a join n y on y.r = b where 100 * k >= 80 * (x.n + y.n - k)),
      reach(r, t) as (select r, r from w union select e.a, t from reach join e on e.b = reach.r),
      m as (select reach.r, min(w.doc_id) as component_id from reach join w on w.r = reach.t group by 1)
      select doc_id, coalesce(n, 0) as n_shingles, component_id, doc_id = component_id as kept from w join m using (r) left join n using (r)""",
    "op4_decontamination": f"""with d as materialized (select doc_id, {_WORDS} as words from documents), b as (select item_id, {_WORDS} as words from benchmark),
      i as materialized (select distinct item_id, least(len(words), 10) as size, array_to_string(words[k : k + 9], ' ') as gram
        from (select item_id, words, unnest(range(1, greatest(len(words) - 8, 2))) as k from b where len(words) > 0)),
      g as (select doc_id, size, k, array_to_string(words[k : k + size - 1], ' ') as gram
        from (select doc_id, words, size, unnest(range(1, len(words) - size + 2)) as k from d, (select distinct size from i) where len(words) >= size)),
      f as materialized (select doc_id, size, k, item_id from g join i using (size, gram)),
      h as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(k, k + size)) as p from (select distinct doc_id, k, size from f)) group by 1),
      t as (select doc_id, count(*) as n_items, string_agg(id, ',' order by id) as ids from (select distinct doc_id, cast(item_id as string) as id from f) group by 1)
      select doc_id, len(coalesce(words, [])) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256,
        coalesce(n_hit, 0) > 0 as contaminated from d left join h using (doc_id) left join t using (doc_id)""",
    "op5_suffix_dedup": """with d as materialized (select doc_id, hex(encode(coalesce(text, ''))) as x from documents),
      w as materialized (select doc_id, i, hash(substr(x, 2 * i + 1, 400)) as a, hash(substr(x, 2 * i + 1, 400) || '/') as b from (select doc_id, x, unnest(range(0, len(x) // 2 - 199)) as i from d where len(x) >= 400)),
      r as (select doc_id, i from (select doc_id, i, count(*) over (partition by a, b) as n from w) where n > 1),
      s as (select doc_id, i, i - lag(i) over (partition by doc_id order by i) as gap from r),
      p as (select doc_id, i, sum(case when gap is null or gap > 200 then 1 else 0 end) over (partition by doc_id order by i) as run from s),
      o as materialized (select doc_id, run, min(i) as low, max(i) + 200 as high from p group by all),
      q as (select doc_id, count(*) as n_spans, sum(high - low) as n_removed, max(high) as last from o group by 1),
      k as (select doc_id, string_agg(piece, '' order by low) as kept from (select doc_id, low, substr(x, 2 * coalesce(lag(high) over (partition by doc_id order by low), 0) + 1,
          2 * (low - coalesce(lag(high) over (partition by doc_id order by low), 0))) as piece from o join d using (doc_id)) group by 1)
      select doc_id, len(x) // 2 as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, coalesce(n_spans, 0) as n_spans,
        sha256(unhex(case when last is null then x else kept || substr(x, 2 * last + 1) end)) as kept_sha256 from d left join q using (doc_id) left join k using (doc_id)""",
    "op12_embedding_dedup": """with recursive v as (select vec_id, label, cast(embedding as double[]) as e from embeddings),
      near as materialized (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id
        and list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.93),
      reach(vec_id, r) as (select vec_id, vec_id from v union select a, r from reach join near on b = vec_id),
      c as (select vec_id, min(r) as component_id from reach group by 1)
      select vec_id, (select count(*) from near where a = c.vec_id) as n_links, component_id, vec_id = component_id as kept from c""",
    "op13_ranked_search": f"""with d as materialized (select doc_id, {_TERMS} as words from documents),
      s as (select count(*) filter (where len(words) > 0) as nn, cast(sum(len(words)) as bigint) as ll from d),
      p as materialized (select doc_id, n, term, count(*) as tf from (select doc_id, cast(len(words) as bigint) as n, unnest(words) as term from d) group by all),
      i as materialized (select distinct item_id, term from (select item_id, unnest({_TERMS}) as term from benchmark)),
      w as (select term, cast(floor(1000 * ln((2e0 * max(nn) + 2) / (2 * count(*) + 1))) as bigint) as w from p, s group by term),
      scored as (select item_id, doc_id, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * nn) // ll))))) as bigint) as score
        from i join p using (term) join w using (term), s group by 1, 2)
      select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as int) as rank, doc_id, score from scored
        where score > 0 qualify row_number() over (partition by item_id order by score desc, doc_id) <= 10""",
}
