"""The operators of this subpackage bound to the shared tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import sql
from quire.llm.runtime import bucket_of, ready

#: A vocabulary file of a public tokenizer; op6 takes another one as an argument.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.url_rank import judge

    return judge(_table(spark, sf_dir, "pages"))


def op2_rp_forest_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate embeddings of one label: links of cosine 0.93 or more and their components."""
    from quire.llm.rp_forest import link_embeddings

    return link_embeddings(_table(spark, sf_dir, "embeddings"))


def op3_raked_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the probability their raked cell gives them, and whether they are sampled."""
    from quire.llm.raking import mix

    mixed = mix(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "lang", "topic", "n_tokens", "probability", "sampled")


def op4_toxic_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text; labels are learned outside the held-out fold, and a null id is in no fold."""
    from quire.llm import toxic_crf

    docs, labels = _table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels")
    model = toxic_crf.train(docs, labels.where(bucket_of(labels.doc_id, 5) != 0))
    scored = toxic_crf.score(docs, model)
    return scored.select("doc_id", F.coalesce(bucket_of(scored.doc_id, 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted", "n_tagged", "spans")


def op5_byte_cnn_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text; labels are learned outside the held-out fold, and a null id is in no fold."""
    from quire.llm import byte_cnn

    docs = _table(spark, sf_dir, "documents")
    model = byte_cnn.train(docs.where(byte_cnn.held_in(docs.doc_id, 4, 2)))
    scored = byte_cnn.predict(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", F.coalesce(bucket_of(scored.doc_id, 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op6_sentencepiece_lattice(spark: SparkSession, sf_dir: str, pieces: str = PIECES) -> DataFrame:
    """Piece ids of every whole text, as a number and a hash, and whether decoding gives the text back."""
    from quire.llm import lattice

    table = lattice.load(pieces)
    rows = lattice.decode(lattice.encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), table), table)
    return rows.select("doc_id", "n_pieces", F.xxhash64("piece_ids").alias("ids_hash"), F.col("decoded").eqNullSafe(F.translate("text", lattice.SPACE, " ")).alias("round_trip"))


def op7_ball_tree_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten largest inner products of every hundredth vector with all others."""
    from quire.llm.ball_tree import top_products

    return top_products(_table(spark, sf_dir, "embeddings"))


def op8_line_edit_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without their repeated and nearly repeated lines."""
    from quire.llm.line_edit import dedup_lines

    return dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of three-word shingles and their groups by two or fewer differing bits."""
    from quire.llm.simhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents stand in directories of their source; the first of each fifty is its directory's licence file."""
    from quire.llm.license_tfidf import scan

    name = F.expr("if(doc_id % 50 = 0, 'LICENSE', concat('doc', doc_id, '.txt'))")
    docs = _table(spark, sf_dir, "documents")
    return scan(docs.select("doc_id", "text", F.concat_ws("/", "source", F.expr("doc_id div 1000"), F.expr("doc_id div 50"), name).alias("path")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(ready(spark), sf_dir)


def queries() -> dict:
    found = {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}
    return found | {"pipeline": pipeline}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_url_rank": sql.op1(),
        "op2_rp_forest_near_dedup": sql.OP2,
        "op3_raked_mix": sql.op3(),
        "op7_ball_tree_top_products": sql.OP7,
        "op8_line_edit_dedup": sql.OP8,
        "op10_license_scan": sql.OP10,
    }
