"""Frameworks named in manifests or seen in sources, and middleware that they should have."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import basename

# Frameworks by manifest, as (framework, language, package).
NODE = (("express", "express"), ("nextjs", "next"), ("react", "react"), ("vue", "vue"), ("fastify", "fastify"), ("koa", "koa"), ("nestjs", "@nestjs/core"))
PYTHON = ("flask", "django", "fastapi")
GO = (("gin", "github.com/gin-gonic/gin"), ("echo", "github.com/labstack/echo"), ("fiber", "github.com/gofiber/fiber"))
PHP = (("laravel", "laravel/framework"), ("symfony", "symfony/framework-bundle"))
RUST = (("actix", "actix-web"), ("axum", "axum"), ("rocket", "rocket"))
SOURCE = (("flask", "python", "from flask import"), ("django", "python", "from django"), ("fastapi", "python", "from fastapi import"), ("express", "javascript", "require('express')"), ("react", "javascript", "from 'react'"), ("gin", "go", '"github.com/gin-gonic/gin"'), ("nethttp", "go", '"net/http"'))
#: Names that rules use for one framework.
ALIASES = {"actix-web": "actix", "next": "nextjs", "next.js": "nextjs", "nest": "nestjs", "net/http": "nethttp"}
#: Middleware that a framework's application should mention.
REQUIRED = (("express", "helmet"), ("express", "rate-limit"), ("express", "cors"), ("django", "SecurityMiddleware"), ("django", "CsrfViewMiddleware"), ("flask", "CSRFProtect"), ("flask", "Talisman"), ("fastapi", "CORSMiddleware"), ("gin", "secure"))
SNIFFED = 20
SCHEMA = "name, version, language, confidence, path"


def detect(files: DataFrame) -> DataFrame:
    """name, version, language, confidence, path: one row for each manifest entry or source that names a framework."""
    base = F.lower(basename(F.col("path")))
    pairs = lambda rows: F.array(*[F.struct(F.lit(n).alias("n"), F.lit(p).alias("p")) for n, p in rows])
    deps = lambda key: F.coalesce(F.from_json(F.get_json_object("content", f"$.{key}"), "map<string,string>"), F.create_map().cast("map<string,string>"))

    def json_manifest(name: str, keys: tuple[str, ...], rows: tuple, language: str) -> DataFrame:
        # Later maps override: development dependencies win.
        entries = F.flatten(F.array(*[F.map_entries(deps(k)) for k in keys]))
        all_of = F.aggregate(entries, F.create_map().cast("map<string,string>"), lambda m, e: F.map_concat(F.map_filter(m, lambda k, v: k != e["key"]), F.create_map(e["key"], e["value"])))
        found = files.where(base == name).select("path", all_of.alias("d"), F.explode(pairs(rows)).alias("f"))
        return found.where(F.map_contains_key("d", F.col("f.p"))).select(F.col("f.n").alias("name"), F.element_at("d", F.col("f.p")).alias("version"), F.lit(language).alias("language"), F.lit("high").alias("confidence"), "path")

    def text_manifest(names: tuple[str, ...], rows: tuple, language: str) -> DataFrame:
        found = files.where(base.isin(*names)).select("path", F.lower("content").alias("c"), F.explode(pairs(rows)).alias("f"))
        return found.where(F.contains("c", F.col("f.p"))).select(F.col("f.n").alias("name"), F.lit("").alias("version"), F.lit(language).alias("language"), F.lit("high").alias("confidence"), "path")

    out = json_manifest("package.json", ("dependencies", "devDependencies"), NODE, "javascript")
    out = out.union(json_manifest("composer.json", ("require", "require-dev"), PHP, "php"))
    out = out.union(text_manifest(("requirements.txt", "pyproject.toml"), tuple((p, p) for p in PYTHON), "python"))
    out = out.union(text_manifest(("go.mod",), GO, "go")).union(text_manifest(("cargo.toml",), RUST, "rust"))
    # The first files by path, as a scan would meet them.
    first = files.where(F.lower(F.col("path")).rlike(r"\.(py|js|ts|go)$")).orderBy("path").limit(SNIFFED)
    seen = first.select("path", "content", F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.lit(l).alias("l"), F.lit(p).alias("p")) for n, l, p in SOURCE])).alias("f"))
    return out.union(seen.where(F.contains("content", F.col("f.p"))).select("f.n", F.lit(""), "f.l", F.lit("medium"), "path"))


def formatted(found: DataFrame) -> DataFrame:
    """One row: names, with versions where known, sorted."""
    text = F.when(F.coalesce("version", F.lit("")) != "", F.concat_ws("@", "name", "version")).otherwise(F.col("name"))
    return found.select(text.alias("t")).distinct().agg(F.array_join(F.sort_array(F.collect_list("t")), ", ").alias("frameworks"))


def canonical(name: str) -> str:
    return ALIASES.get(name.lower(), name.lower())


def missing_middleware(found: DataFrame, files: DataFrame) -> DataFrame:
    """framework, missing: required middleware that no file mentions."""
    need = files.sparkSession.createDataFrame(list(REQUIRED), "framework string, middleware string").join(found.select(F.col("name").alias("framework")).distinct(), "framework")
    mentioned = F.array_compact(F.array(*[F.when(F.col("content").contains(m), F.lit(m)) for m in sorted({m for _, m in REQUIRED})]))
    has = files.select(F.explode(mentioned).alias("middleware")).distinct()
    return need.join(has, "middleware", "left_anti").groupBy("framework").agg(F.sort_array(F.collect_list("middleware")).alias("missing"))
