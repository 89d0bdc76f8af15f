"""Text sources of genotypes and covariates: VCF, HapMap, square matrices, nested JSON, delimited text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from harrow.sources import digests

#: Letters for two different bases: fixed values of the format.
IUPAC_HET = {"R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC"}


def delimited(spark: SparkSession, path: str, schema: StructType | str, sep: str = ",", parts: int | None = None) -> DataFrame:
    """A2: text with a header under a given schema; compressed files cannot be split, so they are dealt anew."""
    df = spark.read.schema(schema).option("header", True).option("sep", sep).option("mode", "PERMISSIVE").csv(path)
    return df.repartition(parts) if parts else df


def whitelisted(df: DataFrame, allowed: list[str], forbidden: list[str]) -> DataFrame:
    """A3: exactly the allowed columns; refuses lists that overlap."""
    if wrong := set(allowed) & set(forbidden):
        raise ValueError(f"forbidden columns: {sorted(wrong)}")
    return df.select(*allowed)


def presence_only(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """A4: whether a number stands there; the value itself goes at once."""
    return df.select(*keys, F.col(value).try_cast("double").isNotNull().alias("has"))


def genotype_dosage(call: Column) -> Column:
    """0, 1 or 2 alternative alleles of a two-allele call such as 0/1 or 1|1; else null."""
    a = F.split(call, r"[/|]")
    one, two = F.try_element_at(a, F.lit(1)), F.try_element_at(a, F.lit(2))
    ok = (F.size(a) == 2) & one.isin("0", "1") & two.isin("0", "1")
    return F.when(ok, one.try_cast("int") + two.try_cast("int"))


def vcf(spark: SparkSession, path: str, wanted: DataFrame | None = None) -> DataFrame:
    """(chrom, pos, ref, alt, entity, dosage) from a VCF text; ``wanted`` (chrom, pos) keeps its sites with one alternative."""
    lines = spark.read.text(path)
    header = lines.filter(F.col("value").startswith("#CHROM")).select(F.split("value", "\t").alias("h"))
    body = lines.filter(~F.col("value").startswith("#")).select(F.split("value", "\t").alias("f"))
    body = body.withColumns({"chrom": F.col("f")[0], "pos": F.col("f")[1].cast("long"), "ref": F.col("f")[3], "alt": F.col("f")[4], "at": F.array_position(F.split(F.col("f")[8], ":"), "GT")})
    if wanted is not None:
        body = body.filter(~F.col("alt").contains(",")).join(wanted, ["chrom", "pos"], "left_semi")
    both = body.crossJoin(F.broadcast(header))  # one header line
    samples = F.slice(F.col("f"), 10, F.greatest(F.size("f") - 9, F.lit(0)))
    long = both.select("chrom", "pos", "ref", "alt", "at", "h", F.posexplode(samples).alias("k", "cell"))
    call = F.try_element_at(F.split("cell", ":"), F.col("at").cast("int"))
    return long.filter(F.col("at") > 0).select("chrom", "pos", "ref", "alt", F.try_element_at("h", F.col("k") + 10).alias("entity"), genotype_dosage(call).alias("dosage"))


def hapmap(df: DataFrame, name: str, alleles: str, samples: list[str]) -> DataFrame:
    """(feature, entity, dosage): first allele 0, second 2, a mixed letter 1."""
    long = df.unpivot([name, alleles], samples, "entity", "call")
    a1, a2 = F.substring_index(alleles, "/", 1), F.substring_index(alleles, "/", -1)
    dosage = F.when(F.col("call") == a1, 0).when(F.col("call") == a2, 2).when(F.col("call").isin(*IUPAC_HET), 1)
    return long.select(F.col(name).alias("feature"), "entity", dosage.alias("dosage"))


def square_matrix(df: DataFrame, row: str, columns: list[str], key) -> DataFrame:
    """(i, j, k) of a square matrix under normalised keys, averaged with its transpose."""
    long = df.unpivot([row], columns, "c", "k").select(key(F.col(row)).alias("i"), key(F.col("c")).alias("j"), F.col("k").cast("double").alias("k"))
    turned = long.select(F.col("j").alias("i"), F.col("i").alias("j"), "k")
    return long.unionByName(turned).groupBy("i", "j").agg(F.avg("k").alias("k"))


def daily_json(texts: DataFrame, text: str, keys: list[str], missing: float = -999.0) -> DataFrame:
    """(keys, variable, day, value) from {"variable": {"yyyymmdd": number}}; the missing code is null."""
    m = texts.select(*keys, F.from_json(text, "map<string,map<string,double>>").alias("m")).select(*keys, F.explode("m").alias("variable", "series"))
    long = m.select(*keys, "variable", F.explode("series").alias("d", "v"))
    return long.select(*keys, "variable", F.to_date(F.try_to_timestamp("d", F.lit("yyyyMMdd"))).alias("day"), F.when(F.col("v") != missing, F.col("v")).alias("value"))


def benchmark_definition(texts: DataFrame, text: str) -> DataFrame:
    """A10: (dataset, period, group) from {"dataset": {"scorable_environments": {"period": [groups]}}}."""
    schema = "map<string, struct<min_genotypes: int, target_years: array<int>, scorable_environments: map<string, array<string>>, methods: array<string>>>"
    m = texts.select(F.explode(F.from_json(text, schema)).alias("dataset", "d"))
    return m.select("dataset", F.explode("d.scorable_environments").alias("period", "groups")).select("dataset", F.col("period").cast("int").alias("period"), F.explode("groups").alias("group"))


def keyed_by_name(df: DataFrame, pattern: str, names: list[str]) -> DataFrame:
    """Key columns from the file name's groups."""
    return df.withColumns({n: F.regexp_extract(F.input_file_name(), pattern, i) for i, n in enumerate(names, 1)})


def replace_slice(df: DataFrame, new: DataFrame, is_slice: Column, keys: list[str]) -> DataFrame:
    """The slice's rows replaced by the new source's rows of the same keys."""
    old = df.filter(is_slice)
    return df.filter(~is_slice).unionByName(new.join(old.select(*keys).distinct(), keys, "left_semi").select(*df.columns))


def before_period(tables: dict[str, DataFrame], period: str, value: int) -> dict[str, DataFrame]:
    """Every table cut to the periods before a target."""
    return {k: t.filter(F.col(period) < value) for k, t in tables.items()}


def missing_units(expected: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    """The units of a grid that are not there yet: the work left, or the reason to refuse scoring."""
    return expected.join(present.select(*keys).distinct(), keys, "left_anti")


def manifest(spark: SparkSession, path: str, whole: int = 128 << 20, levels: tuple[tuple[int, int], ...] = digests.LEVELS) -> DataFrame:
    """(file, bytes, sha256) of the files under a path. Files over ``whole`` bytes are digested piece by piece, so that no task reads or holds one of them."""
    name = F.substring_index("path", "/", -1).alias("file")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    long = files.filter(F.col("length") > whole).select("path", "length", name).collect()
    each = files.filter(F.col("length") <= whole)  # pushed down: contents of other files are not read
    if at_once := [digests.escaped(r["path"]) for r in long if not digests.can_carry(r["path"])]:
        each = each.unionByName(spark.read.format("binaryFile").load(at_once))
    out = each.select(name, F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    rows = [(r["file"], r["length"], digests.sha256_by_pieces(spark, r["path"], r["length"], levels)) for r in long if digests.can_carry(r["path"])]
    return out.unionByName(spark.createDataFrame(rows, "file string, bytes long, sha256 string")) if rows else out


def write_predictions(pred: DataFrame, path: str, keys: tuple[str, ...] = ("dataset", "method")) -> None:
    """One folder for each key; only the folders written are replaced."""
    pred.repartition(*keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def first_calls(df: DataFrame, entity: str, order: str) -> DataFrame:
    """The first row of each entity."""
    return df.withColumn("__k", F.row_number().over(Window.partitionBy(entity).orderBy(order))).filter("__k = 1").drop("__k")
