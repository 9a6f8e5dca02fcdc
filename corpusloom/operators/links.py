"""Links: broken syntax, policy, status of a snapshot, redirects, local targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import pattern, strip
from .findings import findings
from .lines import first_in

# Patterns in order of precedence, transient states, redirect families.
BROKEN_URLS = (
    ("slash_backslash", r"\bhttps?:/\\[^\s<>)\]}\"']+"),
    ("scheme_backslash", r"\bhttps?:\\[^\s<>)\]}\"']+"),
    ("single_slash", r"\bhttps?:/(?![/\\])[^\s<>)\]}\"']+"),
    ("missing_colon", r"\bhttps?//[^\s<>)\]}\"']+"),
    ("space_after_scheme", r"\bhttps?://\s+[^\s<>)\]}\"']+"),
    ("space_before_dot", r"\bhttps?://[^\s/<>)]*\s+\.[^\s<>)\]}\"']+"),
    ("space_after_dot", r"\bhttps?://[^\s/<>)]*\.\s+[^\s<>)\]}\"']+"),
    ("split_domain", r"\bhttps?://[^\s/.<>)]{2,}\s+[^\s/<>)]*\.[^\s<>)\]}\"']+"),
)
TRANSIENT = (408, 425, 429, 500, 502, 503, 504, 520, 521, 522, 523, 524)
REDIRECT_FAMILIES = (("opros.so", "oprosso.ru", "oprosso.net", "new.oprosso.net"),)
#: IPv4 networks that aren't public, as (first, last) numbers of four bytes.
INNER_NETWORKS = tuple(
    (sum(int(b) << s for b, s in zip(a.split("."), (24, 16, 8, 0), strict=True)), (1 << 32 - n) - 1)
    for a, n in (("0.0.0.0", 8), ("10.0.0.0", 8), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 29), ("192.0.0.170", 31), ("192.0.2.0", 24), ("192.168.0.0", 16), ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("240.0.0.0", 4))
)


def _broken(name: str, number: int):
    return lambda v, i: F.struct(F.lit(number).alias("rule_no"), F.lit(name).alias("rule"), i.alias("match_no"), F.regexp_replace(strip(v), r"[.,;]+$", "").alias("quote"))


def broken_urls(lines: DataFrame) -> DataFrame:
    """A finding per broken URL of each line; of equal quotes on a line (any case) the first pattern's."""
    hits = []
    for number, (name, regex) in enumerate(BROKEN_URLS):
        found = F.regexp_extract_all("line", F.lit(pattern(regex, ignore_case=True)), F.lit(0))
        hits.append(F.transform(found, _broken(name, number)))
    maybe = F.lower("line").contains("http")  # most lines leave here
    x = lines.where(maybe).select("unit_id", F.col("relative_path").alias("file_path"), "line_no", F.explode(F.concat(*hits)).alias("h")).select("*", "h.*").drop("h")
    x = first_in(x.withColumn("_key", F.lower("quote")), ["unit_id", "file_path", "line_no", "_key"], ["rule_no", "match_no"])
    return findings(
        x.select(
            "unit_id", "file_path", F.col("line_no").alias("line_start"), F.col("line_no").alias("line_end"), "quote",
            F.lit("links").alias("criterion"), F.lit("major").alias("severity"), F.lit("fail").alias("verdict"), F.lit(0.96).alias("confidence"),
            F.lit("broken_url_syntax_checker").alias("checker_name"), F.lit("broken_url_syntax").alias("issue_type"), F.lit(False).alias("needs_human_review"),
            F.create_map(F.lit("pattern"), "rule").alias("extra"),
        )
    )


def host(url: Column) -> Column:
    return F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")))


def policy_error(url: Column) -> Column:
    """Why a link isn't looked at from outside: scheme, credentials, no host, local name, inner address; null if it may be."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    user = F.coalesce(F.try_parse_url(url, F.lit("USERINFO")), F.lit(""))
    name = host(url)
    parts = F.transform(F.split(name, r"\."), lambda p: p.try_cast("long"))
    is_ip = name.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") & F.forall(parts, lambda p: p <= 255)
    number = F.aggregate(parts, F.lit(0).cast("long"), lambda s, p: s * 256 + p)
    inner = F.lit(False)
    for first, size in INNER_NETWORKS:
        inner = inner | number.between(first, first + size)
    return (
        F.when(~scheme.isin("http", "https"), "scheme")
        .when(user != "", "credentials")
        .when(name == "", "no_host")
        .when((name == "localhost") | name.endswith(".localhost") | name.endswith(".local"), "local_name")
        .when(is_ip & inner, "inner_address")
    )


def path(url: Column) -> Column:
    return F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))


def redirect_rot(url: Column, final: Column) -> Column:
    """Whether a redirect looks like a lost page: another host (not of one family), or a deep path that ends at the root."""
    bare = lambda u: F.regexp_replace(host(u), r"^www\.", "")
    a, b = bare(url), bare(final)
    root = lambda u: path(u).isin("", "/")
    family = F.lit(False)
    for names in REDIRECT_FAMILIES:
        family = family | (a.isin(*names) & b.isin(*names))
    moved = (a != "") & (b != "") & (a != b)
    return F.coalesce(F.when(F.coalesce(final, F.lit("")) == "", False).when(family & ~root(final), False).when(moved, True).otherwise(~root(url) & root(final)), F.lit(False))


def link_status(links: DataFrame, snapshot: DataFrame) -> DataFrame:
    """links (unit_id, file_path, line_start, value) with the snapshot url_status (url, status, final_url, error) -> findings, one ladder.

    The snapshot's url is unique; links are joined to it by value, once.
    """
    x = links.join(snapshot.select(F.col("url").alias("value"), "status", "final_url", "error"), "value", "left")
    error = F.lower(F.coalesce("error", F.lit("")))
    chain = error.contains("перенаправ") | error.contains("redirect")
    rung = (
        F.when(policy_error(F.col("value")).isNotNull(), "policy")
        .when(F.col("status").isNull() & (error == ""), "no_snapshot")
        .when((error != "") & chain, "redirect_chain")
        .when(error != "", "error")
        .when(F.col("status").isin(*TRANSIENT), "transient")
        .when(F.col("status") >= 400, "gone")
        .when(redirect_rot(F.col("value"), F.col("final_url")), "redirect_rot")
    )
    ladder = {"policy": ("info", "unknown", 0.65), "no_snapshot": ("info", "unknown", 0.5), "redirect_chain": ("minor", "warning", 0.65), "error": ("info", "unknown", 0.65), "transient": ("info", "unknown", 0.65), "gone": ("major", "fail", 0.9), "redirect_rot": ("minor", "warning", 0.7)}
    x = x.withColumn("rung", rung).where("rung is not null")
    pick = lambda k: F.coalesce(*(F.when(F.col("rung") == name, F.lit(v[k])) for name, v in ladder.items()))
    return findings(
        x.select(
            "unit_id", "file_path", "line_start", F.col("line_start").alias("line_end"), F.col("value").alias("quote"), F.col("value").alias("source"),
            F.lit("links").alias("criterion"), pick(0).alias("severity"), pick(1).alias("verdict"), pick(2).alias("confidence"),
            F.lit("link_checker").alias("checker_name"), F.col("rung").alias("issue_type"), (F.col("rung") != "gone").alias("needs_human_review"),
        )
    )


def resolved(directory: Column, target: Column) -> Column:
    """A relative target below a directory, without . and ..; null if it leaves the unit."""
    full = F.when(directory == "", target).otherwise(F.concat(directory, F.lit("/"), target))
    parts = F.filter(F.split(full, "/"), lambda p: ~p.isin("", "."))
    state = "struct<kept:array<string>,out:boolean>"

    def step(s: Column, p: Column) -> Column:
        up = p == ".."
        out = s["out"] | (up & (F.size(s["kept"]) == 0))
        kept = F.when(up, F.slice(s["kept"], F.lit(1), F.greatest(F.size(s["kept"]) - 1, F.lit(0)))).otherwise(F.concat(s["kept"], F.array(p)))
        return F.struct(kept.alias("kept"), out.alias("out")).cast(state)

    done = F.aggregate(parts, F.struct(F.array().alias("kept"), F.lit(False).alias("out")).cast(state), step)
    return F.when(~done["out"], F.array_join(done["kept"], "/"))


def missing_images(images: DataFrame, paths: DataFrame) -> DataFrame:
    """Markdown images (unit_id, file_path, line_start, value) whose local target isn't among the unit's paths (unit_id, relative_path)."""
    local = images.where(~F.lower("value").rlike("^(https?:|data:)"))
    folder = F.regexp_replace("file_path", "[^/]*$", "")
    target = resolved(F.regexp_replace(folder, "/$", ""), F.regexp_replace(F.col("value"), "[?#].*$", ""))
    x = local.withColumn("target", target)
    there = paths.select("unit_id", F.col("relative_path").alias("target")).distinct()
    x = x.join(there, ["unit_id", "target"], "left_anti")
    return findings(
        x.select(
            "unit_id", "file_path", "line_start", F.col("line_start").alias("line_end"), F.col("value").alias("quote"),
            F.lit("links").alias("criterion"), F.lit("major").alias("severity"), F.lit("fail").alias("verdict"), F.lit(0.95).alias("confidence"),
            F.lit("local_link_checker").alias("checker_name"), F.lit("missing_local_image").alias("issue_type"), F.lit(False).alias("needs_human_review"),
        )
    )
