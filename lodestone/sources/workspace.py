"""Files of a folder as a table of paths and texts, and the rules that choose among them."""

from __future__ import annotations

from fnmatch import translate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.ids import safe_child

# File names searched by default, and folders never searched.
DEFAULT_GLOBS = ("*.md", "*.txt", "*.rst", "*.py", "*.js", "*.jsx", "*.ts", "*.tsx", "*.swift", "*.kt", "*.java", "*.go", "*.rs", "*.c", "*.h", "*.cpp", "*.hpp", "*.json", "*.yaml", "*.yml", "*.toml", "*.sh", "*.bash", "*.zsh", "*.html", "*.css", "*.sql", "*.proto")
EXCLUDED_FOLDERS = (".git", ".hg", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".svn", ".tox", ".venv", "__pycache__", "build", "dist", "htmlcov", "node_modules", "vendor")
MOST_FILES = 20_000


def chosen(path: Column, globs: tuple[str, ...] | list[str] = DEFAULT_GLOBS) -> Column:
    """Whether a relative path is safe, outside excluded folders, and its file name matches a pattern."""
    parts = F.split(path, "/")
    folders, name = F.slice(parts, F.lit(1), F.size(parts) - 1), F.element_at(parts, -1)
    java = "|".join("(?:" + translate(g).replace("\\z", "").replace("\\Z", "").replace("(?s:", "(?:") + ")" for g in globs)
    return safe_child(path) & ~F.arrays_overlap(folders, F.array(*[F.lit(x) for x in EXCLUDED_FOLDERS])) & name.rlike(f"^(?:{java})$")


def selected_paths(paths: DataFrame, globs: tuple[str, ...] | list[str] = DEFAULT_GLOBS) -> DataFrame:
    return paths.filter(chosen(F.col("path"), globs))


def read_folder(spark: SparkSession, root: str, globs: tuple[str, ...] | list[str] = DEFAULT_GLOBS, *, most_bytes: int = 1_000_000, most_files: int | None = MOST_FILES) -> DataFrame:
    """path (relative to `root`) and text of the chosen files, read by Spark. Larger files are skipped.

    Paths and sizes are listed first; only the chosen files' contents are read, where they lie, so texts stay in as many
    partitions as there are. `most_files`: at most so many, the first by path; None for all. Files of excluded folders
    aren't among the chosen. A root that isn't there is `invalid_input`.
    """
    base = root.rstrip("/").split("://")[-1].removeprefix("file:")
    rel = F.substring_index("path", base + "/", -1)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        raise ValueError(f"invalid_input: search root does not exist: {root}")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).withColumn("rel", rel)
    fit = files.filter((F.col("length") <= most_bytes) & chosen(F.col("rel"), globs))
    if most_files is not None:
        last = fit.select("rel").orderBy("rel").offset(most_files).limit(1).first()  # paths alone
        if last is not None:
            fit = fit.filter(F.col("rel") < last["rel"])
    text = F.col("content").cast("string")
    return fit.select(F.col("rel").alias("path"), F.coalesce(F.try_validate_utf8(text), F.make_valid_utf8(text)).alias("text"))


def ripgrep_matches(raw: DataFrame) -> DataFrame:
    """path, line_no, snippet from rows of ripgrep's JSON output (column value); what is no match is left out."""
    shape = "type string, data struct<path:struct<text:string>,lines:struct<text:string>,line_number:bigint>"
    rows = raw.select(F.from_json("value", shape).alias("v")).filter("v.type = 'match' and v.data.path.text <> '' and v.data.lines.text <> '' and v.data.line_number is not null")
    rows = rows.select(F.col("v.data.path.text").alias("path"), F.col("v.data.line_number").alias("line_no"), F.trim(F.regexp_replace("v.data.lines.text", r"^\s+|\s+$", "")).alias("snippet"))
    return rows.filter(safe_child(F.col("path")))
