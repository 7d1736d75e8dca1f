"""Per-project summaries over code_facts: A1, A2, W8, J2."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.functions.paths import import_root
from tokenloom.functions.scores import complexity_grade
from tokenloom.operators.ranking import ranked

# Import root -> framework label (one entry per root).
FRAMEWORKS = [
    ("fastapi", "FastAPI"), ("flask", "Flask"), ("django", "Django"), ("starlette", "Starlette"),
    ("sanic", "Sanic"), ("aiohttp", "aiohttp"), ("tornado", "Tornado"), ("litestar", "Litestar"),
    ("sqlalchemy", "SQLAlchemy"), ("sqlmodel", "SQLModel"), ("tortoise", "Tortoise ORM"), ("peewee", "Peewee"),
    ("pymongo", "PyMongo"), ("motor", "Motor (async MongoDB)"), ("redis", "Redis"), ("elasticsearch", "Elasticsearch"),
    ("pydantic", "Pydantic"), ("marshmallow", "Marshmallow"), ("attrs", "attrs"),
    ("celery", "Celery"), ("dramatiq", "Dramatiq"), ("rq", "RQ"), ("arq", "arq"),
    ("pytest", "pytest"), ("unittest", "unittest"), ("hypothesis", "Hypothesis"),
    ("typer", "Typer"), ("click", "Click"), ("argparse", "argparse"),
    ("numpy", "NumPy"), ("pandas", "pandas"), ("torch", "PyTorch"), ("tensorflow", "TensorFlow"),
    ("sklearn", "scikit-learn"), ("transformers", "HuggingFace Transformers"),
    ("httpx", "HTTPX"), ("requests", "Requests"),
    ("jose", "python-jose (JWT)"), ("jwt", "PyJWT"), ("passlib", "passlib"), ("bcrypt", "bcrypt"),
    ("boto3", "AWS boto3"), ("google", "Google Cloud"), ("azure", "Azure SDK"),
    ("rich", "Rich"), ("loguru", "Loguru"), ("structlog", "structlog"), ("alembic", "Alembic"),
    ("anyio", "AnyIO"), ("trio", "Trio"),
]


def framework_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FRAMEWORKS, "import_root string, framework string")


def detect_frameworks(spark: SparkSession, facts: DataFrame) -> DataFrame:
    """Distinct (project, import root, label); the label table has a fixed
    size (50 rows), so it is broadcast."""
    roots = facts.select("project", F.explode("imports").alias("m")).select(
        "project", import_root(F.col("m")).alias("import_root")).distinct()
    return roots.join(F.broadcast(framework_table(spark)), "import_root").select("project", "import_root", "framework")


def project_totals(spark: SparkSession, facts: DataFrame, extra_languages: DataFrame) -> DataFrame:
    """A1: files, lines, functions, classes, typed functions, languages, frameworks."""
    t = facts.groupBy("project").agg(
        F.count(F.lit(1)).cast("long").alias("files"), F.sum("lines").cast("long").alias("total_lines"),
        F.sum(F.size("functions")).cast("long").alias("total_functions"),
        F.sum(F.size("classes")).cast("long").alias("total_classes"),
        F.sum("typed_functions").cast("long").alias("typed_functions"))
    fw = detect_frameworks(spark, facts).groupBy("project").agg(
        F.array_join(F.array_sort(F.collect_set("framework")), ", ").alias("frameworks"))
    langs = extra_languages.select("project", F.array_join(F.array_union(F.array(F.lit("python")),
                                                                         F.array_sort("extra_languages")), ",").alias("languages"))
    return (t.join(langs, "project", "left").join(fw, "project", "left")
            .select("project", "files", "total_lines", "total_functions", "total_classes", "typed_functions",
                    F.coalesce("languages", F.lit("python")).alias("languages"),
                    F.coalesce("frameworks", F.lit("")).alias("frameworks")))


def quality_summary(facts: DataFrame) -> DataFrame:
    """A2: average complexity per file (1 dp) and typed share with max(n, 1)."""
    g = facts.groupBy("project").agg(F.sum("complexity").alias("cx"), F.count(F.lit(1)).alias("n"),
                                     F.sum("typed_functions").alias("typed"), F.sum(F.size("functions")).alias("fns"))
    return g.select("project", F.round(F.col("cx") / F.col("n"), 1).alias("avg_complexity"),
                    F.round(F.col("typed") / F.greatest(F.col("fns"), F.lit(1)) * 100.0, 1).alias("type_coverage_pct"))


def quality_table(facts: DataFrame) -> DataFrame:
    """Files by complexity, highest first (ties by path), with their rank,
    type coverage and grade."""
    cov = F.when(F.size("functions") > 0, F.col("typed_functions") / F.size("functions") * 100.0).otherwise(F.lit(0.0))
    rows = facts.select("project", "path", F.col("complexity").cast("long"), F.round(cov, 1).alias("type_coverage"),
                        complexity_grade("complexity").alias("grade"))
    return ranked(rows, F.desc("complexity"), F.asc("path"))
