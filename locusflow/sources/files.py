"""Sources and sinks of sequence and interval files; all parsing happens in Spark tasks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequence import chunks

BED = "contig string, start long, end long, name string, score double, strand string"
VCF = "contig string, pos long, id string, ref string, alt string, qual string, filter string, info string, format string, sample string"
GTF = "contig string, source string, feature string, start long, end long, score string, strand string, frame string, attributes string"


def tsv(spark: SparkSession, path: str | Sequence[str], schema: str, columns: Sequence[str] | None = None, header: bool = False, comment: str | None = None, sep: str = "\t") -> DataFrame:
    """A delimited file with a given schema; only ``columns`` are parsed.  gzip is read as it is (one task a file)."""
    reader = spark.read.schema(schema).option("sep", sep).option("header", header).option("quote", '"')
    df = (reader.option("comment", comment) if comment else reader).csv(path)
    return df.select(*columns) if columns else df


def bed(spark: SparkSession, path: str | Sequence[str], extra: str = "") -> DataFrame:
    return tsv(spark, path, BED + (f", {extra}" if extra else ""))


def vcf(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    return tsv(spark, path, VCF, columns, comment="#")


def vcf_intervals(variants: DataFrame) -> DataFrame:
    """Variants as 0-based intervals with the alleles in the info."""
    return variants.select("contig", (F.col("pos") - 1).alias("start"), F.col("pos").alias("end"), F.concat(F.lit("GT="), "ref", F.lit("/"), "alt", F.lit(";"), F.coalesce("info", F.lit(""))).alias("info"))


def variant_ids(df: DataFrame, column: str) -> DataFrame:
    """``chr_pos_ref_alt`` as columns."""
    parts = F.split(column, "_")
    return df.withColumns({"contig": parts[0], "pos": F.get(parts, F.lit(1)).try_cast("long"), "ref": F.get(parts, F.lit(2)), "alt": F.get(parts, F.lit(3))})


def fasta(spark: SparkSession, path: str | Sequence[str], upper: bool = False, mask_repeats: bool = False, most: int | None = None) -> DataFrame:
    """(name, seq) of records that may span lines; large files are split between records."""
    records = spark.read.option("lineSep", "\n>").text(path)
    text = F.regexp_replace(F.regexp_replace("value", r"\r", ""), r"^>", "")
    seq = F.regexp_replace(F.regexp_extract("t", r"(?s)^[^\n]*\n(.*)$", 1), r"[\n>]", "")
    out = records.select(text.alias("t")).filter("t <> ''").select(F.trim(F.substring_index("t", "\n", 1)).alias("name"), (F.upper(seq) if upper else seq).alias("seq"))
    if mask_repeats:
        out = out.withColumn("seq", F.regexp_replace("seq", "[acgt]", "-"))
    return out.limit(most) if most else out


def write_fasta(df: DataFrame, path: str, width: int = 80) -> None:
    """Records with sequences wrapped at a width."""
    wrapped = F.regexp_replace(F.regexp_replace("seq", f"(.{{{width}}})", "$1\n"), r"\n$", "")
    df.select(F.concat(F.lit(">"), "name", F.lit("\n"), wrapped)).write.text(path)


def sequence_index(df: DataFrame) -> DataFrame:
    return df.select("name", F.length("seq").alias("length"))


def name_parts(spark: SparkSession, written: str, path: str, name: str) -> None:
    """Gives every part file of a written folder one name, in numbered folders below a path: ``path/0/name``, ``path/1/name``, ..."""
    at = spark._jvm.org.apache.hadoop.fs.Path
    fs = at(written).getFileSystem(spark._jsc.hadoopConfiguration())
    parts = sorted(f.getPath().toString() for f in fs.listStatus(at(written)) if f.getPath().getName().startswith("part-"))
    for i, part in enumerate(parts):
        if not (fs.mkdirs(at(f"{path}/{i}")) and fs.rename(at(part), at(f"{path}/{i}/{name}"))):
            raise OSError(f"{part} could not be renamed")


def merged_species(spark: SparkSession, path: str) -> DataFrame:
    """Files of one species each (a path, or a pattern of them): names get the species, which is the file's name, in front."""
    records = spark.read.option("lineSep", "\n>").text(path).withColumn("species", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.[^./]+$", 1))
    body = F.regexp_replace("value", r"^>", "")
    return records.select("species", body.alias("t")).select(F.concat_ws(":", "species", F.trim(F.substring_index("t", "\n", 1))).alias("name"), F.regexp_replace(F.regexp_extract("t", r"(?s)^[^\n]*\n(.*)$", 1), r"\n", "").alias("seq"))


def tiles(genome: DataFrame, size: int) -> DataFrame:
    """A genome (name, seq) as tiles (contig, tile, seq), to be written once and joined by (contig, tile); one pass over each sequence."""
    return genome.select(F.col("name").alias("contig"), F.posexplode(chunks("seq", size)).alias("tile", "seq")).withColumn("tile", F.col("tile").cast("long"))


def write_tiles(genome: DataFrame, table: str, size: int, buckets: int = 64, path: str | None = None) -> DataFrame:
    """Tiles as a table in buckets by (contig, tile): ``fetch`` then moves the regions to the buckets, never the genome.  Tiles are dealt by bucket first, so a bucket is one file."""
    writer = tiles(genome, size).repartition(buckets, "contig", "tile").write.bucketBy(buckets, "contig", "tile").sortBy("contig", "tile").format("parquet")
    (writer.option("path", path) if path else writer).saveAsTable(table)
    return genome.sparkSession.table(table)


def fetch(regions: DataFrame, tiled: DataFrame, size: int) -> DataFrame:
    """Sequences of ``regions(name, contig, start, end)``: each region meets the tiles it covers, with the part of each that it needs; ends beyond the contig are cut, regions without a base get none."""
    wanted = regions.select("name", "contig", "start", "end").filter("start < end").withColumn("tile", F.explode(F.expr(f"sequence(greatest(start, 0) div {size}, (end - 1) div {size})")))
    low = F.greatest(F.col("start") - F.col("tile") * size, F.lit(0))
    part = F.substr("seq", (low + 1).cast("int"), F.greatest(F.least(F.col("end") - F.col("tile") * size, F.lit(size)) - low, F.lit(0)).cast("int"))
    parts = wanted.join(tiled, ["contig", "tile"]).select("name", "contig", "start", "end", F.struct("tile", part.alias("seq")).alias("p"))
    joined = parts.groupBy("name", "contig", "start", "end").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda x: x["seq"]), "").alias("seq"))
    return joined.filter("seq <> ''")


def genome_chunks(index: DataFrame, length: int, overlap: int, least: int = 6) -> DataFrame:
    """Overlapping pieces (chunk, name, start, end; from 1, both ends in) of sequences (name, length), named ``name:start-end``; pieces under a least length go."""
    last = F.greatest(F.col("length") - overlap, F.lit(1)) - 1
    starts = F.when(last >= 1, F.sequence(F.lit(1).cast("long"), last.cast("long"), F.lit(length - overlap).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    cut = index.select("name", "length", F.explode(starts).alias("start")).withColumn("end", F.least(F.col("start") + length - 1, F.col("length").cast("long"))).filter(F.col("end") - F.col("start") + 1 >= least)
    return cut.select(F.concat("name", F.lit(":"), F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string")).alias("chunk"), "name", "start", "end")


def maf(spark: SparkSession, path: str) -> DataFrame:
    """Alignment blocks: (block, row, species, contig, start, size, strand, contig_length, seq); negative-strand starts are turned to the forward strand."""
    blocks = spark.read.option("lineSep", "\n\n").text(path).withColumn("block", F.monotonically_increasing_id())
    lines = blocks.select("block", F.posexplode(F.split("value", "\n")).alias("row", "line")).filter(F.col("line").startswith("s ") | F.col("line").startswith("s\t"))
    p = F.split("line", r"\s+")
    rows = lines.select("block", "row", p[1].alias("name"), p[2].cast("long").alias("own_start"), p[3].cast("long").alias("size"), p[4].alias("strand"), p[5].cast("long").alias("contig_length"), p[6].alias("seq"))
    start = F.when(F.col("strand") == "-", F.col("contig_length") - F.col("own_start") - F.col("size")).otherwise(F.col("own_start"))
    name = F.split("name", r"\.", 2)
    return rows.select("block", "row", name[0].alias("species"), F.get(name, F.lit(1)).alias("contig"), start.alias("start"), "size", "strand", "contig_length", "seq")


def write_maf(df: DataFrame, path: str) -> None:
    """Blocks as text; a block's rows stay in order."""
    own = F.when(F.col("strand") == "-", F.col("contig_length") - F.col("start") - F.col("size")).otherwise(F.col("start"))
    line = F.concat_ws(" ", F.lit("s"), F.concat_ws(".", "species", "contig"), own.cast("string"), F.col("size").cast("string"), "strand", F.col("contig_length").cast("string"), "seq")
    blocks = df.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("row", line.alias("line")))).alias("rows"))
    blocks.select(F.concat(F.lit("a\n"), F.concat_ws("\n", F.transform("rows", lambda r: r["line"])), F.lit("\n"))).write.text(path)


def bedgraph(spark: SparkSession, path: str, first_only: bool = False) -> DataFrame:
    """(contig, pos, score) with 1-based positions: every base of a run, or its first."""
    runs = tsv(spark, path, "contig string, start long, end long, score double", comment="#").filter("start < end")
    if first_only:
        return runs.select("contig", (F.col("start") + 1).alias("pos"), "score")
    return runs.select("contig", F.explode(F.expr("sequence(start + 1, end)")).alias("pos"), "score")


def gtf(spark: SparkSession, path: str, feature: str) -> DataFrame:
    """Rows of one feature as 0-based intervals with gene and transcript names."""
    rows = tsv(spark, path, GTF, comment="#").filter(F.col("feature") == feature)
    attribute = lambda k: F.nullif(F.regexp_extract("attributes", rf'{k} "([^"]*)"', 1), F.lit(""))
    return rows.select("contig", (F.col("start") - 1).alias("start"), "end", "strand", attribute("gene_name").alias("gene"), attribute("transcript_id").alias("transcript"))


def links(pages: DataFrame, html: str = "html", contains: str = "") -> DataFrame:
    """Every link target of each page."""
    found = pages.select(*[c for c in pages.columns if c != html], F.explode(F.regexp_extract_all(html, F.lit(r'<a\s[^>]*?href="([^"]*)"'), F.lit(1))).alias("href"))
    return found.filter(F.col("href").contains(contains)) if contains else found


def training_log(lines: DataFrame) -> DataFrame:
    """Metric events of lines like ``[time] checkpoint N - split (epoch: E; sequences: S; ...), loss: x, name: y`` or ``[time] epoch N - split (sequences: S; ...), loss: x``.

    Metrics begin at the first ``loss``; those with ``=`` in their value have none.
    """
    field = lambda p: F.regexp_extract("value", p, 1)
    rows = lines.filter(F.col("value").rlike(r"(?:epoch|checkpoint) [0-9]+ - [A-Za-z]+")).select(
        F.to_timestamp(field(r"^\[([^\]]*)\]"), "yyyy/MM/dd-HH:mm:ss").alias("ts"), field(r"checkpoint ([0-9]+)").try_cast("int").alias("checkpoint"),
        field(r"(?:epoch|checkpoint) [0-9]+ - ([A-Za-z]+)").alias("split"), field(r"epoch:? ([0-9]+)").try_cast("int").alias("epoch"), field(r"sequences: ([0-9]+)").try_cast("long").alias("n_sequences"),
        F.explode(F.split(field(r"(?:epoch|checkpoint).*(loss.*)"), r",\s*")).alias("metric"),
    )
    return rows.select("ts", "n_sequences", "epoch", "checkpoint", "split", F.trim(F.substring_index("metric", ":", 1)).alias("metric"), F.trim(F.substring_index("metric", ":", -1)).try_cast("double").alias("value"))


def later_wins(spark: SparkSession, path: str, key: str, defaults: dict[str, object] | None = None) -> DataFrame:
    """Sharded Parquet results: for each key the row of the last file by name; missing columns get defaults."""
    df = spark.read.option("mergeSchema", True).parquet(path).withColumn("_file", F.col("_metadata.file_path"))
    columns = [c for c in df.columns if c not in (key, "_file")]
    out = df.groupBy(key).agg(F.max_by(F.struct(*columns), "_file").alias("_r")).select(key, "_r.*")
    for c, v in (defaults or {}).items():
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(v)) if c in out.columns else F.lit(v))
    return out


def with_path_fields(df: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Columns from the file path by regular expressions with one group."""
    return df.withColumns({name: F.regexp_extract(F.col("_metadata.file_path"), pattern, 1) for name, pattern in fields.items()})


def tagged_union(tables: dict[tuple, DataFrame], names: Sequence[str]) -> DataFrame:
    """Result tables with their parameters as columns, one under the other; missing columns are null."""
    out = None
    for values, df in tables.items():
        part = df.withColumns({n: F.lit(v) for n, v in zip(names, values, strict=True)})
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def provenance(spark: SparkSession, path: str) -> DataFrame:
    """Path, checksum, size and time of files."""
    return spark.read.format("binaryFile").load(path).select("path", F.md5("content").alias("md5"), "length", "modificationTime")


def without_columns(df: DataFrame, holding: Sequence[str]) -> DataFrame:
    """All columns whose names hold none of some substrings; the others are never read."""
    return df.select(*[c for c in df.columns if not any(h in c for h in holding)])


def with_prefix(df: DataFrame, prefix: str, also: Sequence[str] = ()) -> DataFrame:
    return df.select(*also, *[c for c in df.columns if c.startswith(prefix)])


def write_tsv(df: DataFrame, path: str, order: Sequence[str] = (), header: bool = False, compression: str | None = None) -> None:
    writer = (df.orderBy(*order) if order else df).write.option("sep", "\t").option("header", header)
    (writer.option("compression", compression) if compression else writer).csv(path)


def write_names(df: DataFrame, column: str, path: str) -> None:
    df.select(F.col(column).cast("string")).write.text(path)


def read_names(spark: SparkSession, path: str, column: str = "name") -> DataFrame:
    return spark.read.text(path).withColumnRenamed("value", column)


def write_config(spark: SparkSession, values: dict, path: str) -> None:
    spark.createDataFrame([values]).write.mode("overwrite").json(path)


def write_shards(df: DataFrame, path: str, shard: str) -> None:
    """A folder for each shard; rows are dealt by shard first, so each is few files."""
    df.repartition(shard).write.partitionBy(shard).parquet(path)




def read_config(spark: SparkSession, path: str) -> dict:
    """What ``write_config`` wrote: one row of parameters (null ones are left out)."""
    return {k: v for k, v in spark.read.json(path).first().asDict(recursive=True).items() if v is not None}


def rename_map(spark: SparkSession, path: str) -> DataFrame:
    """(old, new) of a file with two names on a line, between white space."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).filter(F.trim("value") != "").select(parts[0].alias("old"), F.get(parts, F.lit(1)).alias("new"))


def renamed(df: DataFrame, column: str, names: DataFrame) -> DataFrame:
    """Values of a column renamed by a table (old, new); those that it lacks stay."""
    out = df.join(names.select(F.col("old").alias(column), F.col("new").alias("_new")), column, "left")
    return out.select(*(F.coalesce("_new", c).alias(c) if c == column else F.col(c) for c in df.columns))


def listed_files(spark: SparkSession, metadata: DataFrame, path: str, schema: str) -> DataFrame:
    """The files that a metadata table lists (one path a row), one under the other, beside the row of the table; paths are few, rows are not."""
    paths = [r[0] for r in metadata.select(path).distinct().limit(100_001).collect()]
    if len(paths) > 100_000:
        raise ValueError("more than 100,000 listed files")
    rows = tsv(spark, paths, schema).withColumn("_file", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1))
    return rows.join(metadata.withColumn("_file", F.regexp_extract(path, r"([^/]+)$", 1)), "_file").drop("_file")
