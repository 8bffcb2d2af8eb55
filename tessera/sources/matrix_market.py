"""Matrix Market files and stored matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core import ArgumentError, SparseMatrix


def first_line(lines: DataFrame, where: str) -> str | None:
    """The first line that fits, by the names of the files; a reader begins with the largest file of a folder."""
    for path in sorted(lines.inputFiles()):
        # A local path is listed as file:/// and read as file:/.
        found = lines.where(F.col("_metadata.file_path").isin(path, path.replace(":///", ":/", 1))).where(where).first()
        if found is not None:
            return found.value
    return None


def read_matrix_market(spark: SparkSession, path: str) -> SparseMatrix:
    """A coordinate file, or a folder of its parts in the order of their names. The header and the size line are read first; entries are split where they are
    read. Symmetric and Hermitian files store the lower triangle."""
    lines = spark.read.text(path)
    words = (first_line(lines, "TRUE") or "").lower().split()
    if len(words) < 5 or words[0] != "%%matrixmarket" or words[1:3] != ["matrix", "coordinate"] or words[3] not in ("real", "integer", "complex", "pattern") or words[4] not in ("general", "symmetric", "hermitian"):
        raise ArgumentError("not a Matrix Market coordinate file")
    content = "NOT startswith(value, '%') AND trim(value) <> ''"
    body = lines.where(content)
    size = first_line(lines, content)
    try:
        m, n, _ = map(int, size.split())
    except (AttributeError, ValueError) as e:
        raise ArgumentError("the size line is damaged") from e
    is_size = F.col("value") == size
    parts = body.select(is_size.alias("is_size"), F.split(F.trim("value"), "\\s+").alias("p"))
    value = {"complex": F.struct(F.get("p", F.lit(2)).cast("double").alias("re"), F.get("p", F.lit(3)).cast("double").alias("im")), "pattern": F.lit(1.0)}.get(words[3], F.get("p", F.lit(2)).cast("double"))
    out = parts.select("is_size", F.get("p", F.lit(0)).cast("long").alias("i"), F.get("p", F.lit(1)).cast("long").alias("j"), value.alias("v"))
    outside = f"(i < 1 OR j < 1 OR i > {m} OR j > {n})"
    found = out.agg(F.count_if(F.expr(f"NOT is_size AND {outside}")).alias("outside"), F.count_if("is_size").alias("sizes")).first()
    if found.outside:
        raise ArgumentError("indices out of range")
    # An entry of the last cell may read as the size line does; then one of the two lines is the entry.
    sizes = out.where("is_size").limit(found.sizes - 1)
    out = out.where("NOT is_size").union(sizes).drop("is_size") if found.sizes > 1 else out.where("NOT is_size").drop("is_size")
    if words[4] == "general":
        return SparseMatrix(out, m, n)
    # The upper triangle is what a symmetric handle stores.
    turned = F.struct(F.col("v").re.alias("re"), (-F.col("v").im).alias("im")) if words[3] == "complex" and words[4] == "hermitian" else F.col("v")
    return SparseMatrix(out.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), F.when(F.col("i") > F.col("j"), turned).otherwise(F.col("v")).alias("v")), m, n, words[4])


def write_matrix_market(a: SparseMatrix, path: str) -> None:
    """A folder of text files: the header and the size line are one row, which sorts first; entries follow in column-major order."""
    kind = "integer" if a.df.schema["v"].dataType.simpleString() in ("int", "bigint") else "real"
    body = a.entries.select(F.col("j"), F.col("i"), F.concat_ws(" ", "i", "j", "v").alias("value"))
    head = a.spark.createDataFrame([(0, 0, f"%%MatrixMarket matrix coordinate {kind} general\n{a.m} {a.n} {a.entries.count()}")], "j long, i long, value string")
    head.union(body).orderBy("j", "i").select("value").write.text(path)
