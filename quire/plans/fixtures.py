"""Deterministic page, segment, box and pixel tables made from the shared ones.

They give every rule something to work on: snippets of text by the document's
number, integer metrics that hit the limits exactly, boxes from words, rasters
from embeddings.  The same arithmetic stands in the SQL of ``quire.oracles``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What is put below a document's text by its number modulo 16.
APPENDED = {
    1: "CARTA D'IDENTITA COGNOME: ROSSI NOME: MARIO DATA DI NASCITA: 01/01/1990 CITTADINANZA ITALIANA SESSO M",
    2: "FIRMA SCADENZA 2028 RILASCIATO DA QUESTURA C<ITA<<<<<<<<ROSSI<<MARIO<<<",
    3: "Unique Identification Authority AADHAAR enrollment id 1234",
    4: "file:///C:/Users/x/scan.png https://upload.wikimedia.org/a/b storyblok",
    5: "???? a  \tb\n\n\n•••••\ufffd\x01",
    6: "identity card surname: SMITH - given name: ANNA place of birth London",
    7: "signature - expiry date valid until 2030 barcode seal stamp",
    10: "k: 1\nk: 2",
    11: "2/17/26, 9:23 AM Preview Google Chrome",
    12: "< < <<",
    13: "firma timbro",
    14: "photo image",
}
#: Texts of further rows, one for each document of that number modulo 16, whose own number is this much larger.
ADDED, FURTHER = {8: "", 9: "12 34 ## 56"}, 10**12


def spread(df: DataFrame) -> DataFrame:
    """Over all cores, if the files give fewer tasks than there are: a small file of one row group is one task."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def by_page(df: DataFrame) -> DataFrame:
    """Dealt by page over all cores at least, before a page becomes many rows, so that these lie together and need no shuffle."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "page")


def augmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id``, ``text``, ``source`` and page keys of every document, and of further rows with texts of edge cases.

    Each fiftieth document has a page of its own, so that some pages have one segment.
    """
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))
    bucket = F.col("doc_id") % 16
    text = F.col("text")
    for n, snippet in APPENDED.items():
        text = F.when(bucket == n, F.concat("text", F.lit("\n"), F.lit(snippet))).otherwise(text)
    further = docs.where(bucket.isin(*ADDED)).select((F.col("doc_id") + FURTHER).alias("doc_id"), F.when(bucket == 8, ADDED[8]).otherwise(ADDED[9]).alias("text"), "source")
    docs = docs.withColumn("text", text).union(further)
    page = F.expr("cast(if(doc_id % 50 = 0, 6, doc_id % 10 div 2 + 1) as int)")
    seg = F.expr("cast(if(doc_id div 10 % 2 = 0, doc_id % 2 + 1, 2 - doc_id % 2) as int)")
    return docs.select("doc_id", F.expr("doc_id div 10").alias("file"), page.alias("page"), seg.alias("seg"), "text", "source")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments with integer-made metrics: ``ocr_confidence`` in tenths, ``ink_ratio`` in thousandths."""
    return augmented(spark, sf_dir).withColumns({"ocr_confidence": F.expr("cast(doc_id * 7 % 1001 as double) / 10"), "ink_ratio": F.expr("cast(doc_id * 37 % 1000 as double) / 1000")})


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page records: a document is a page of its source's folder."""
    rows = segments(spark, sf_dir)
    return rows.select(F.col("source").alias("folder"), F.concat(F.lit("f"), F.col("file").cast("string"), F.lit(".pdf")).alias("file"), F.col("doc_id").alias("page"), "ink_ratio", F.col("ocr_confidence").alias("ocr_conf"), "text")


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A box for each word; every page has its own base confidence, some boxes are blank, unsure or broken."""
    words = augmented(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", r"[ \n]+", -1)).alias("pos", "word"))
    conf = F.expr("case when pos % 29 = 0 then 'n/a' when pos % 23 = 0 then '-1' else cast(doc_id * 7 % 90 + pos * 17 % 11 as string) end")
    blank = F.expr("pos % 13 = 0 or (doc_id % 11 = 0 and pos % 3 <> 0)")
    return words.select("doc_id", F.col("pos").alias("box_idx"), F.when(blank, " ").otherwise(F.col("word")).alias("text"), conf.alias("conf"))


def two_mode_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of a weak first reading and of a second one."""
    weak = boxes(spark, sf_dir).withColumn("n", F.col("conf").try_cast("int"))
    modes = F.explode(F.array(F.struct(F.lit("balanced").alias("mode"), F.lit(5).alias("part")), F.struct(F.lit("enhanced").alias("mode"), F.lit(3).alias("part"))))
    rows = weak.select("*", modes.alias("m"))
    return rows.select("doc_id", "box_idx", "text", F.expr("cast(n div m.part as string)").alias("conf"), F.col("m.mode").alias("mode"))


def rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grey images: embeddings scaled to 0..255, and with each a blank and a two-valued one."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.expr("transform(embedding, x -> cast(x as double))").alias("v"))
    low, high = F.array_min("v"), F.array_max("v")
    scaled = F.when(high > low, F.transform("v", lambda x: F.floor((x - low) / (high - low) * 255).cast("int"))).otherwise(F.transform("v", lambda x: F.lit(0)))
    some = [F.struct(F.lit(0).alias("kind"), scaled.alias("pixels")), F.struct(F.lit(1).alias("kind"), F.expr("transform(v, x -> cast(vec_id % 256 as int))").alias("pixels")), F.struct(F.lit(2).alias("kind"), F.expr("transform(v, (x, i) -> if(i % 4 = 0, 10, 200))").alias("pixels"))]
    return vectors.select("vec_id", F.explode(F.array(*some)).alias("i")).select("vec_id", "i.kind", "i.pixels")


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contours on a page of 600 x 400 for each order, among them touching, nested and equal ones."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("n"))
    return items.groupBy("page", "n").agg(F.count("*").alias("_c")).selectExpr(
        "page", "cast(n as int) as idx", "cast((page * 7 + n * 83) % 450 as int) as x", "cast((page * 3 + n * 61) % 320 as int) as y",
        "cast(80 + (page + n * 5) % 5 * 20 as int) as w", "cast(40 + (page * 2 + n) % 4 * 20 as int) as h",
        "cast((80 + (page + n * 5) % 5 * 20) * (40 + (page * 2 + n) % 4 * 20) as double) as area", "600 as page_w", "400 as page_h",
    )


def profiles(spark: SparkSession, sf_dir: str, shift: int = 0) -> DataFrame:
    """An ink profile for each customer, with a gap whose place and width the number, moved by ``shift``, decides."""
    base = by_page(spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("page"))).select("page", (F.col("page") + shift).alias("n"), F.expr(f"cast(60 + (page + {shift}) % 60 as int)").alias("size"))
    rows = base.select("page", "n", "size", F.explode(F.expr("sequence(0, size - 1)")).alias("pos"))
    ink = "case when n % 17 = 0 then 0 when pos >= n % size and pos < n % size + n % 9 then pos % 4 when pos % 31 = 0 then 1 else 20 + (pos * 7 + n) % 30 end"
    return rows.selectExpr("page", "pos", f"cast({ink} as int) as ink")


def cascade_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each customer, as wide and high as its profiles by column and by row are long."""
    return spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr("c_custkey as page", "cast(60 + (c_custkey + 5) % 60 as int) as page_w", "cast(60 + c_custkey % 60 as int) as page_h")


def cascade_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A contour of a document's size on some of those pages, one too small on others."""
    some = cascade_pages(spark, sf_dir).where("page % 4 < 2")
    return some.selectExpr("page", "page_w", "page_h", "0 as idx", "2 as x", "2 as y", "if(page % 4 = 0, 50, 5) as w", "if(page % 4 = 0, 30, 3) as h", "cast(if(page % 4 = 0, 1500, 15) as double) as area")
