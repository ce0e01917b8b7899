"""Readers and writers of the engine's text formats, and the bundle loader.

Tables persist as Parquet. The headerless TSV forms are for exchange: fixed ones go through the CSV
source, ragged ones through lines of text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TITLES = "title string, id int"
REDIRECTS = "from_title string, to_title string"
TERM_DF = "term string, df int"
ANCHORS = "mention string"


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A headerless TSV of fixed width; nothing is quoted."""
    return spark.read.csv(path, schema=schema, sep="\t", quote="", escape="")


def write_tsv(df: DataFrame, path: str) -> None:
    """A headerless TSV; replaces what is there."""
    df.write.mode("overwrite").csv(path, sep="\t", quote="", escape="", emptyValue="")


def write_outputs(parent: DataFrame, outputs: dict[str, tuple[Column, str]]) -> None:
    """Several outputs of one frame, each (condition, path), from one computation of it."""
    kept = parent.persist()
    try:
        for condition, path in outputs.values():
            kept.where(condition).write.mode("overwrite").parquet(path)
    finally:
        kept.unpersist()


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value): the lines of text files."""
    return spark.read.text(path)


def _fields() -> Column:
    return F.split("value", "\t")


def parse_mentions(lines: DataFrame) -> DataFrame:
    """(mention, linked, total, candidates) of ``mention linked total id...`` lines."""
    f = _fields()
    return lines.select(f[0].alias("mention"), f[1].cast("int").alias("linked"), f[2].cast("int").alias("total"), F.slice(f, 4, F.greatest(F.size(f) - 3, F.lit(0))).cast("array<int>").alias("candidates"))


def _pairs(first: int) -> Column:
    part = F.slice(_fields(), first, F.greatest(F.size(_fields()) - (first - 1), F.lit(0)))
    return F.filter(part, lambda x: x.contains(","))


def format_candidates(rows: DataFrame) -> DataFrame:
    """(value): ``mention name_freq id,freq...`` lines of candidate rows, ids ascending."""
    pair = F.concat_ws(",", "entity_id", "freq")
    by_id = F.transform(F.array_sort(F.collect_list(F.struct("entity_id", pair.alias("p")))), lambda x: x["p"])
    return rows.groupBy("mention", "name_freq").agg(F.concat_ws("\t", by_id).alias("p")).select(F.concat_ws("\t", "mention", "name_freq", "p").alias("value"))


def parse_candidates(lines: DataFrame) -> DataFrame:
    """(mention, name_freq, entity_id, freq) of such lines."""
    f = _fields()
    rows = lines.select(f[0].alias("mention"), f[1].cast("bigint").alias("name_freq"), F.explode(_pairs(3)).alias("p"))
    return rows.select("mention", "name_freq", F.split("p", ",")[0].cast("int").alias("entity_id"), F.split("p", ",")[1].cast("bigint").alias("freq"))


def format_entity_links(rows: DataFrame) -> DataFrame:
    """(value): ``entity total out src,freq...`` lines of in-link entries."""
    pairs = F.array_join(F.transform("links", lambda x: F.concat_ws(",", x["src"], x["freq"])), "\t")
    return rows.select(F.concat_ws("\t", "entity_id", "total_freq", "out_links", pairs).alias("value"))


def parse_entity_links(lines: DataFrame) -> DataFrame:
    """(entity_id, total_freq, out_links, links) of such lines."""
    f = _fields()
    pair = lambda x: F.struct(F.split(x, ",")[0].cast("int").alias("src"), F.split(x, ",")[1].cast("bigint").alias("freq"))
    return lines.select(f[0].cast("int").alias("entity_id"), f[1].cast("bigint").alias("total_freq"), f[2].cast("bigint").alias("out_links"), F.transform(_pairs(4), pair).alias("links"))


def parse_inlinks(lines: DataFrame) -> DataFrame:
    """(entity_id, srcs) of ``entity src...`` lines."""
    f = _fields()
    return lines.select(f[0].cast("int").alias("entity_id"), F.slice(f, 2, F.greatest(F.size(f) - 1, F.lit(0))).cast("array<int>").alias("srcs"))


def parse_scored_mentions(lines: DataFrame, begin: str, end: str) -> DataFrame:
    """(mention, linked, total): lines with a tab and a score between two markers; the score in hundred-thousandths, cut off."""
    marked = lines.where(F.col("value").contains("\t") & F.col("value").contains(begin))
    score = F.substring_index(F.substring_index("value", begin, -1), end, 1).cast("double")
    return marked.select(F.substring_index("value", "\t", 1).alias("mention"), (score * 100000).cast("int").alias("linked"), F.lit(100000).alias("total"))


_ANNOTATION = "docName string, wikiName string, offset int, length int"


def format_annotations(rows: DataFrame) -> DataFrame:
    """(value): an XML element for each annotation of ``rows``(filename, name, off, len)."""
    one = F.struct(F.col("filename").alias("docName"), F.col("name").alias("wikiName"), F.col("off").alias("offset"), F.col("len").alias("length"))
    return rows.select(F.to_xml(one, {"rowTag": "annotation"}).alias("value"))


def parse_annotations(lines: DataFrame) -> DataFrame:
    """(filename, name, off, len) of such elements."""
    a = lines.select(F.from_xml("value", _ANNOTATION).alias("a"))
    return a.select(F.trim("a.docName").alias("filename"), F.trim("a.wikiName").alias("name"), F.col("a.offset").alias("off"), F.col("a.length").alias("len"))


def read_annotations(spark: SparkSession, path: str, row_tag: str = "annotation") -> DataFrame:
    """(filename, name, off, len) of an XML file with docName, wikiName, offset and length in each annotation."""
    rows = spark.read.format("xml").option("rowTag", row_tag).schema(_ANNOTATION).load(path)
    return rows.select(F.trim("docName").alias("filename"), F.trim("wikiName").alias("name"), F.col("offset").alias("off"), F.col("length").alias("len"))


def keep_annotations(rows: DataFrame, titles: DataFrame, skip_non_canonical: bool) -> DataFrame:
    """Annotations with a name, with the entity of that name; -1 if it is no title, or left out."""
    named = rows.where("name is not null and name <> ''").join(titles.select(F.col("title").alias("name"), F.col("id").alias("entity_id")), "name", "left")
    return named.where("entity_id is not null") if skip_non_canonical else named.na.fill(-1, ["entity_id"])


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(filename, text) of whole text files; each line ends with a line feed."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("filename"), F.regexp_replace("value", "\r\n?", "\n").alias("text"))
    return rows.withColumn("text", F.when((F.col("text") == "") | F.col("text").endswith("\n"), F.col("text")).otherwise(F.concat("text", F.lit("\n"))))


def parse_manual_annotations(lines: DataFrame, order: str) -> DataFrame:
    """(doc, name, off, url, context) of DOC / NAME / OFFSET / URL / CONTEXT lines; a record ends with its CONTEXT.

    ``order`` is a column that gives the order of lines; the file is read in one partition, as it is typed by hand.
    """
    tagged = lines.select(order, F.trim(F.substring_index("value", ":", 1)).alias("tag"), F.trim(F.expr("substring(value, instr(value, ':') + 1)")).alias("v"))
    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    last = lambda tag: F.last(F.when(F.col("tag") == tag, F.col("v")), ignorenulls=True).over(w)
    rows = tagged.select("tag", last("DOC").alias("doc"), last("NAME").alias("name"), last("OFFSET").cast("int").alias("off"), last("URL").alias("url"), last("CONTEXT").alias("context"))
    return rows.where("tag = 'CONTEXT'").drop("tag")


def repair_offsets(annotations: DataFrame, docs: DataFrame) -> DataFrame:
    """Annotations with the offset that their context gives in the text; -1 if the context is not found."""
    rows = annotations.join(docs.select(F.col("filename").alias("doc"), "text"), "doc")
    place = F.expr("locate(context, text)")
    return rows.withColumn("off", F.when(place > 0, place - 1 + F.expr("locate(name, context)") - 1).otherwise(F.lit(-1))).drop("text")


def read_sequence_file(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Key and value of a legacy SequenceFile of simple writables as a frame of two columns."""
    return spark.createDataFrame(spark.sparkContext.sequenceFile(path), schema)


def write_sequence_file(df: DataFrame, path: str) -> None:
    """The first two columns of ``df`` as a SequenceFile."""
    df.rdd.map(lambda r: (r[0], r[1])).saveAsSequenceFile(path)


def load_kb(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """All tables of a stored knowledge base by name."""
    names = ("titles", "redirects", "dictionary", "inlinks", "term_df", "vectors")
    return {n: spark.read.parquet(f"{path}/{n}.parquet") for n in names}


def store_kb(base, path: str) -> None:
    """The knowledge base of ``plans.base.Base`` as Parquet; vectors and in-links are laid out by entity for look-ups."""
    base.read("titles").write.mode("overwrite").parquet(f"{path}/titles.parquet")
    base.read("redirects").distinct().write.mode("overwrite").parquet(f"{path}/redirects.parquet")
    base.dictionary.write.mode("overwrite").parquet(f"{path}/dictionary.parquet")
    base.df.write.mode("overwrite").parquet(f"{path}/term_df.parquet")
    for name in ("inlinks", "vectors"):
        getattr(base, name).repartitionByRange("entity_id").sortWithinPartitions("entity_id").write.mode("overwrite").parquet(f"{path}/{name}.parquet")
