"""The plug-in point: a detector takes a corpus and returns findings."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import cached_property
from typing import Protocol

from pyspark.sql import DataFrame

from pyspark.sql import functions as F

from .materialize import scratch
from .operators import checklists, consistency, context, curriculum, dependencies, links, markdown, readability, resources, rights, similarity
from .operators.entities import entities
from .operators.findings import calibrated, postprocessed, reported, union_findings
from .operators.images import image_quality
from .operators.lines import lines


@dataclass
class Corpus:
    """Files and the tables made of them, built when a detector asks.

    lookups are tables about the world outside: url_status, registry, availability_rules, image_inventory, artifact_text,
    units (unit_id, name).
    """

    files: DataFrame
    paths: DataFrame | None = None
    lookups: dict[str, DataFrame] = field(default_factory=dict)

    @cached_property
    def lines(self) -> DataFrame:
        return lines(self.files)

    @cached_property
    def all_paths(self) -> DataFrame:
        return self.paths if self.paths is not None else self.files.select("unit_id", "relative_path")

    @cached_property
    def units(self) -> DataFrame:
        return self.lookups.get("units", self.all_paths.select("unit_id", F.col("unit_id").alias("name")).distinct())

    def mentioned(self, *types: str) -> DataFrame:
        return entities(self.files, types)

    @cached_property
    def dependencies(self) -> DataFrame:
        return dependencies.candidates(self.files)

    @cached_property
    def questions(self) -> DataFrame:
        return checklists.questions(self.files)

    @cached_property
    def hints(self) -> DataFrame:
        return curriculum.language_hints(self.files, self.all_paths, self.units)


class Detector(Protocol):
    name: str
    needs: tuple[str, ...]

    def detect(self, corpus: Corpus) -> DataFrame: ...


@dataclass(frozen=True)
class Rule:
    """A detector made of a function; it runs if the lookups that it needs are there."""

    name: str
    function: Callable[[Corpus], DataFrame]
    needs: tuple[str, ...] = ()

    def detect(self, corpus: Corpus) -> DataFrame:
        return self.function(corpus)


def _curriculum(c: Corpus) -> DataFrame:
    own = curriculum.line_signals(c.lines, c.hints)
    return curriculum.curriculum_findings(own).unionByName(curriculum.curriculum_findings(curriculum.missing_topics(c.files, c.hints)))


def _services(c: Corpus) -> DataFrame:
    return c.mentioned("link", "technology").select("unit_id", "file_path", "line_start", "value", "quote")


def _pictures(c: Corpus) -> DataFrame:
    folder = F.regexp_replace(F.regexp_replace("file_path", "[^/]*$", ""), "/$", "")
    return c.mentioned("image").withColumn("target", links.resolved(folder, F.regexp_replace("value", "[?#].*$", "")))


DETECTORS: tuple[Detector, ...] = (
    Rule("structure", lambda c: resources.structure(c.all_paths)),
    Rule("broken_urls", lambda c: links.broken_urls(c.lines)),
    Rule("repeated_headings", lambda c: markdown.repeated_headings(c.lines)),
    Rule("chapter_order", lambda c: markdown.chapter_order(c.lines)),
    Rule("numbered_lists", lambda c: markdown.numbered_lists(c.lines)),
    Rule("labels", lambda c: markdown.labels(c.lines)),
    Rule("missing_resources", lambda c: resources.missing_resources(c.lines, c.all_paths)),
    Rule("placeholders", lambda c: readability.placeholders(c.lines)),
    Rule("editorial", lambda c: readability.editorial(c.lines, readability.java_units(c.all_paths), readability.artifact_lines(c.lookups["contents"], c.files) if "contents" in c.lookups else None)),
    Rule("language_mismatches", lambda c: readability.language_mismatches(c.files)),
    Rule("sort_conflicts", lambda c: consistency.sort_conflicts(c.lines)),
    Rule("table_mismatches", lambda c: consistency.table_mismatches(c.lines)),
    Rule("units_without_license", lambda c: rights.units_without_license(c.files)),
    Rule("market_fit", lambda c: context.market_fit(c.lines, c.all_paths)),
    Rule("call_outputs", lambda c: context.call_outputs(c.lines)),
    Rule("foreign_materials", lambda c: context.foreign_materials(c.lines, c.all_paths, c.lookups.get("units"))),
    Rule("missing_images", lambda c: links.missing_images(c.mentioned("image"), c.all_paths)),
    Rule("unconfirmed_paths", lambda c: resources.unconfirmed_paths(c.lines, c.all_paths)),
    Rule("resources_without_artifact", lambda c: resources.resources_without_artifact(c.lines, c.all_paths)),
    Rule("guides_without_image", lambda c: resources.guides_without_image(c.all_paths)),
    Rule("word_definitions", lambda c: consistency.word_definitions(c.lines)),
    Rule("field_variants", lambda c: consistency.field_variants(c.lines)),
    Rule("length_conflicts", lambda c: consistency.length_conflicts(c.lines)),
    Rule("dataset_terms", lambda c: rights.dataset_terms(c.files)),
    Rule("copied_code", lambda c: rights.copied_code(similarity.code_matches(similarity.code_docs(c.files)))),
    Rule("checklist_alignment", lambda c: checklists.alignment(c.questions, checklists.readmes(c.files))),
    Rule("checklist_grounding", lambda c: checklists.grounding_findings(checklists.grounding(c.questions, checklists.readmes(c.files), c.all_paths, c.lookups.get("artifact_text")))),
    Rule("curriculum", _curriculum),
    Rule("link_status", lambda c: links.link_status(c.mentioned("link"), c.lookups["url_status"]), ("url_status",)),
    Rule("image_quality", lambda c: image_quality(c.mentioned("image"), c.lookups["image_inventory"]), ("image_inventory",)),
    Rule("image_sources", lambda c: rights.image_sources(_pictures(c), c.files, c.lookups["image_inventory"]), ("image_inventory",)),
    Rule("dependency_licenses", lambda c: rights.dependency_licenses(c.dependencies, c.lookups["registry"]), ("registry",)),
    Rule("dependency_freshness", lambda c: dependencies.freshness(c.dependencies, c.lookups["registry"]), ("registry",)),
    Rule("dependency_compatibility", lambda c: dependencies.compatibility(c.dependencies, c.lookups["registry"]), ("registry",)),
    Rule("availability", lambda c: dependencies.availability(_services(c), c.lookups["availability_rules"]), ("availability_rules",)),
)


def _written(parts: Iterable[DataFrame]) -> DataFrame:
    """All rows of all parts. A job writes each part, as one plan of all of them takes longer to make than to run; parts with the same columns go to one table."""
    tables: dict[tuple, tuple[str, DataFrame]] = {}
    for part in parts:
        path, _ = tables.setdefault(tuple(part.dtypes), (scratch(part.sparkSession), part))
        part.write.mode("append").parquet(path)
    return union_findings([x.sparkSession.read.schema(x.schema).parquet(path) for path, x in tables.values()])


def audit(corpus: Corpus, detectors: Iterable[Detector] = DETECTORS) -> tuple[DataFrame, DataFrame]:
    """(findings to report, findings that left and why) of all detectors whose lookups are there."""
    found = _written(d.detect(corpus) for d in detectors if all(n in corpus.lookups for n in d.needs))
    kept, dropped = postprocessed(calibrated(found))
    return reported(kept), dropped
