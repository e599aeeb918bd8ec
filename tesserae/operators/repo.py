"""Repository understanding over files (repo, path, content)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions import fixed, text


def select_files(files: DataFrame, most: int = 20) -> DataFrame:
    """Named files in their order, then readable ones by depth and path; not tests, vendored or built ones."""
    order = F.create_map(*(F.lit(x) for k, name in enumerate(fixed.PRIORITY_FILES) for x in (name, k)))
    low = F.lower("path")
    readable = low.rlike("(" + "|".join(x.replace(".", r"\.") for x in fixed.READABLE) + ")$") & ~low.rlike("|".join(re.escape(x) for x in fixed.SKIPPED_PATHS))
    depth = F.length("path") - F.length(F.replace(F.col("path"), F.lit("/"), F.lit("")))
    ranked = files.withColumn("_o", F.coalesce(F.try_element_at(order, F.col("path")), F.lit(999))).filter((F.col("_o") < 999) | readable)
    return ranked.withColumn("rank", F.row_number().over(Window.partitionBy("repo").orderBy("_o", depth, "path"))).filter(F.col("rank") <= most).drop("_o")


def dependencies(files: DataFrame) -> DataFrame:
    """Distinct names from manifests."""
    c, p = F.col("content"), F.col("path")
    every = lambda pattern: F.regexp_extract_all(c, F.lit(pattern), F.lit(1))
    keys = lambda where: F.coalesce(F.json_object_keys(F.get_json_object(c, where)), F.array().cast("array<string>"))
    found = (
        F.when(p.isin("setup.py", "setup.cfg", "pyproject.toml", "requirements.txt"), every(fixed.MANIFEST_NAMES["python"]))
        .when(p == "package.json", F.concat(keys("$.dependencies"), keys("$.devDependencies")))
        .when(p == "Cargo.toml", every(fixed.MANIFEST_NAMES["Cargo.toml"]))
        .when(p == "go.mod", every(fixed.MANIFEST_NAMES["go.mod"]))
    )
    return files.select("repo", F.explode(found).alias("name")).filter(F.length("name") > 1).distinct()


def api_surface(files: DataFrame) -> DataFrame:
    """Distinct public names."""
    c = F.col("content")
    every = lambda pattern: F.regexp_extract_all(c, F.lit(pattern), F.lit(1))
    language = text.file_language(F.col("path"))
    found = (
        F.when(language == "python", F.concat(*map(every, fixed.PUBLIC_NAMES["python"])))
        .when(language.isin("javascript", "typescript"), F.concat(*map(every, fixed.PUBLIC_NAMES["javascript"])))
        .when(language == "go", every(*fixed.PUBLIC_NAMES["go"]))
        .when(language == "rust", every(*fixed.PUBLIC_NAMES["rust"]))
    )
    names = files.select("repo", F.explode(found).alias("name")).distinct()
    return names.filter((F.length("name") >= 2) & ~F.col("name").startswith("_") & ~F.col("name").startswith("test"))


def project_type(files: DataFrame) -> DataFrame:
    """One label for each repository."""
    base = F.lower(F.regexp_extract("path", "[^/]*$", 0))
    low = F.lower("path")
    has = lambda name: F.max((base == name).cast("int")) == 1
    tree = lambda word: F.max(F.contains(low, F.lit(word)).cast("int")) == 1
    package = lambda word: F.max(((base == "package.json") & F.contains("content", F.lit(word))).cast("int")) == 1
    label = (
        F.when(has("package.json") & (package("react") | package("next")), "React / Next.js app")
        .when(has("package.json") & (package("express") | package("fastify")), "Node.js backend")
        .when(has("package.json"), "Node.js project")
        .when((has("setup.py") | has("pyproject.toml")) & (tree("fastapi") | tree("flask")), "Python web API")
        .when((has("setup.py") | has("pyproject.toml")) & (tree("lib") | tree("src")), "Python library")
        .when(has("setup.py") | has("pyproject.toml"), "Python project")
        .when(has("cargo.toml"), "Rust project")
        .when(has("go.mod"), "Go project")
        .when(has("dockerfile"), "Containerised service")
        .otherwise("Unknown")
    )
    return files.groupBy("repo").agg(label.alias("project_type"))


def understanding(files: DataFrame, *, lines: int = 100, blocks: int = 15) -> DataFrame:
    """For each repository a Markdown text of its chosen files, their code blocks, type, dependencies and names."""
    chosen = select_files(files)
    head = F.array_join(F.slice(F.split("content", "\n"), 1, lines), "\n")
    part = chosen.select("repo", "rank", F.concat(F.lit("## "), "path", F.lit("\n\n"), head).alias("md"), F.struct(head.alias("snippet"), text.file_language(F.col("path")).alias("language")).alias("code"))
    built = part.groupBy("repo").agg(F.sort_array(F.collect_list(F.struct("rank", "md", "code"))).alias("p"))
    names = lambda df, name: df.groupBy("repo").agg(F.sort_array(F.collect_set("name")).alias(name))
    return (
        built.select(
            "repo",
            F.array_join(F.transform("p", lambda x: x["md"]), "\n\n").alias("content"),
            F.slice(F.filter(F.transform("p", lambda x: x["code"]), lambda c: F.length(c["snippet"]) > 100), 1, blocks).alias("code_blocks"),
        )
        .join(project_type(files), "repo")
        .join(names(dependencies(files), "dependencies"), "repo", "left")
        .join(names(api_surface(files), "api"), "repo", "left")
    )
