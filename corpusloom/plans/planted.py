"""Text rules over whole documents with lines put into them: what a rule looks for, what it must leave alone, and what other rules look for.

Every document is a file of a unit of 16, so units don't grow with the tables. Three lines are put into its text, one of them in the middle of a word; which ones and
where follows from the text. `planted_oracles` has the same results as SQL that reads the texts with the rules' patterns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import once
from ..operators import align, consistency, context, curriculum, entities, links, markdown, readability, resources, rights
from ..operators.lines import lines
from ..sources import tables as t

H, DIGIT = "substr(md5(text), 1, 6)", "cast(ascii(substr(md5(text), 2, 1)) % 3 as string)"
#: Lines, with the texts' own signs in them: ~h~ six of its hash, ~d~ a digit, ~i~ up to three I, ~n~ a line end.
PLANTS = (
    "Our COMANY sells", 'we use `code` and "Name ~h~" here', "## Built with ASP.NET", "в компании работались люди", "| COMANY |", "```", "## Chapter I of it", "## Chapter IV", "# chapter ii", "### Chapter XI~i~", "## Chapter ~i~",
    "Output~n~~n~42", "Example: fine", "Result~n~`x`", "Output of the program", "- Example~n~Output~n~[1, 2]", "Result 12", "A function has 10-20 lines", "methods of 20 to 10 lines",
    "functions: 3~d~ – 20 lines, a method 5-7 lines", "30-40 lines of text", "Download the dataset data_~h~.csv", "Download the archive", "Open the provided image", "Get the dataset from https://x.example/data and load it",
    "Get the archive", "this capture is given", "Look at /opt/app/~h~/run, then /var/log.", "Look at http://x.example/opt/app", "Look at a/opt/app and /optional", "add( 1, 2); // ~d~", "add(1,2) // 1", "get(x) // {2: 1, 1:~d~}",
    "get( x ) // `{1: 1,2 :1}`", "add(1) //", "Follow PEP 8", "Follow the Google C++ style", "gofmt it all", "Use checkstyle with care", "Write it for .NET or in C# now", "Run make to build the target",
    "make build target with Maven", "Write in C11", "Read about the debugger", "Never use goto", "What is #include for", "The int and char data types", "gcc: quest 1, quest 2, quest 3", "A console game", "customer data of a shop",
    "the Target Audience", "KPI and churn", "unit test with KPI", "unit test of revenue", "We load the dataset ~h~", "A dataset under the license of X", "See kaggle.com/datasets/x",
    "Open https://Host~h~.example/x/), file `src/a_~h~.py` and «Two  words, here» or «one»", "Load rows.csv and `my data.XLSX`, then shot.png", "Get `my data.xlsx` from https://x.example/d", "Save the result to out_~h~.csv",
    "Open a.zip; the output is written to report.json", "Create the archive all.zip from the given rows.csv", "The attached file is part_~h~.sql", "Analyze the dump part_~h~.sql", "See ![shot](img/~h~.png) there",
    "![a](../materials/notes.md) and ![b](../../out.png)", "![c](./main.java?raw=1) ![d](https://a.example/b.png)", "![e](x/../README.md#top)", "Задачами проектов и на кошка", "задача, проекты!", "Ошибками задачи проекту",
    "## Theory", "### Task 2", "The release of ~h~ was published in 2020 by its own team. Docker is the standard of it all!", "You must install the release of 2020 before all of the others.", "In 2020.",
    "| The latest release of 2020 | was published by its own team |", "- [The latest style](https://x.example/~h~) is supported by all of them since 2019-05",
    "The project is built and tested with the latest release of its standard tools", "See http:/Broken.example/a. and (docs/Read-me.MD), «Ein Wort: zwei»",
)


def _plant(shift: int, factor: int) -> str:
    """The line of a text as an expression that both engines read alike; a part of one literal, as a case for each line makes too much code."""
    x = f"split_part('{'^'.join(PLANTS)}', '^', cast((cast(length(text) as bigint) * {factor} + doc_id * 3 + {shift}) % {len(PLANTS)} as int) + 1)"
    for sign, value in (("~h~", H), ("~d~", DIGIT), ("~i~", "repeat('I', cast(length(text) % 4 as int))"), ("~n~", "chr(10)")):
        x = f"replace({x}, '{sign}', {value})"
    return x


_AT = "cast((cast(length(text) as bigint) * 7919 + doc_id) % (length(text) + 1) as int)"
#: The files; the name says what kind of file it is.
FILES = {
    "unit_id": "concat('u', cast(cast((doc_id - doc_id % 16) / 16 as bigint) as string))",
    "relative_path": "concat(cast(doc_id as string), case length(text) % 5 when 0 then '/README.md' when 1 then '/guide.txt' when 2 then '/materials/notes.md' when 3 then '/src/main.java' else '/src/main.c' end)",
    "kind": "case length(text) % 5 when 0 then 'readme' when 1 then 'text' when 2 then 'material' else 'code' end",
    "text": f"concat({_plant(0, 1)}, chr(10), substr(text, 1, {_AT}), chr(10), {_plant(1, 5)}, chr(10), substr(text, {_AT} + 1, length(text)), chr(10), {_plant(2, 11)})",
}
#: Files without text, beside them.
ARTIFACTS = {
    "unit_id": FILES["unit_id"],
    "relative_path": "concat(cast(doc_id as string), case length(text) % 41 when 0 then '/disk.OVA' when 1 then '/rows.csv' when 2 then '/old.tar.gz' when 3 then '/shot.png' when 4 then '/data/sales.csv' when 5 then '/test/data/sales.csv' when 6 then '/docs/VirtualBox guide.md' when 7 then '/Образ машины.md' when 8 then '/avm.md' else '/a.bin' end)",
}
#: Files at the root of units: some that a unit must have, some whose names are only like them.
ROOTS = {
    "unit_id": FILES["unit_id"],
    "relative_path": "case length(text) % 23 when 0 then 'README.MD' when 1 then 'readme_x.md' when 2 then 'check-list.yml' when 3 then 'Check-List_rus.YAML' when 4 then 'a_readme.md' when 5 then 'check-list.yml.txt' else concat('readme.', cast(length(text) as string)) end",
}


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    # as rows of a generator, so that filters don't work the text out again for each pattern
    row = ", ".join(f"{e} as {c}" for c, e in FILES.items())
    return t.table(spark, sf_dir, "documents").where("text is not null").selectExpr(f"inline(array(struct({row})))")


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = t.table(spark, sf_dir, "documents").where("text is not null")
    return docs.selectExpr(*(f"{FILES[c]} as {c}" for c in ARTIFACTS)).unionAll(docs.selectExpr(*(f"{e} as {c}" for c, e in ARTIFACTS.items())))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(files(spark, sf_dir))


def editorial_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of the editorial rules on prose lines; units with Java files have one more rule."""
    x = readability.editorial(_lines(spark, sf_dir), readability.java_units(files(spark, sf_dir)))
    return x.select("unit_id", "file_path", "line_start", "issue_type", "quote", "confidence")


def chapter_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = markdown.chapter_order(_lines(spark, sf_dir))
    return x.select("unit_id", "file_path", "line_start", "quote", F.element_at("extra", "first_line").cast("int").alias("first_line"))


def label_punctuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown.labels(_lines(spark, sf_dir)).select("unit_id", "file_path", "line_start", "quote", "confidence")


def length_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consistency.length_conflicts(_lines(spark, sf_dir)).select("unit_id", "file_path", "line_start", "quote")


def unconfirmed_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = resources.unconfirmed_paths(_lines(spark, sf_dir), paths(spark, sf_dir))
    return x.select("unit_id", "file_path", "line_start", "quote", "verdict", "confidence")


def resources_without_artifact(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = resources.resources_without_artifact(_lines(spark, sf_dir), paths(spark, sf_dir))
    return x.select("unit_id", "file_path", "line_start", "quote", "verdict", "confidence")


def call_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls whose documented output differs between files of a unit."""
    return context.call_outputs(_lines(spark, sf_dir)).select("unit_id", "file_path", "line_start", "quote", F.element_at("extra", "call").alias("call"))


def foreign_materials(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = context.foreign_materials(_lines(spark, sf_dir), paths(spark, sf_dir))
    return x.select("unit_id", "file_path", "line_start", "quote", F.element_at("extra", "tech_lang").alias("tech"), F.element_at("extra", "unit_lang").alias("language"))


def _hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = files(spark, sf_dir)
    return curriculum.language_hints(own, paths(spark, sf_dir), own.select("unit_id", F.col("unit_id").alias("name")).distinct())


def curriculum_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals of single lines, by the languages of the unit and the line."""
    x = curriculum.line_signals(_lines(spark, sf_dir), _hints(spark, sf_dir))
    return x.select("unit_id", "relative_path", "line_no", "issue_type", "severity", "criterion", "strong")


def missing_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics that the files of a unit in C need and don't explain."""
    x = curriculum.curriculum_findings(curriculum.missing_topics(files(spark, sf_dir), _hints(spark, sf_dir)))
    return x.select("unit_id", "file_path", "line_start", "quote", "severity", F.element_at("extra", "topic").alias("topic"))


def market_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = context.market_fit(_lines(spark, sf_dir), paths(spark, sf_dir))
    return x.select("unit_id", F.element_at("extra", "market_fit_score").cast("int").alias("score"), "severity", "verdict", F.round("confidence", 6).alias("confidence"))


def dataset_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rights.dataset_terms(files(spark, sf_dir)).select("unit_id", "file_path", "quote", "confidence")


def text_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, file names and quoted phrases of whole texts."""
    x = files(spark, sf_dir).withColumn("a", align.anchors(F.col("text")))
    return x.select("relative_path", *(F.array_join(f"a.{c}", " | ").alias(c) for c in ("urls", "files", "phrases")))


def missing_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named inputs that a unit doesn't have."""
    x = resources.missing_resources(_lines(spark, sf_dir), paths(spark, sf_dir))
    return x.select("unit_id", "file_path", "line_start", "quote", "verdict", "confidence")


def environment_guides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resources.guides_without_image(paths(spark, sf_dir)).select("unit_id", "file_path", "quote", "confidence")


def unit_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = t.table(spark, sf_dir, "documents").where("text is not null")
    x = docs.selectExpr(*(f"{e} as {c}" for c, e in ROOTS.items()))
    return resources.structure(x.unionAll(paths(spark, sf_dir))).select("unit_id", "criterion", "issue_type", "severity", "verdict", "confidence")


def missing_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures in texts whose local target isn't there."""
    images = entities.entities(files(spark, sf_dir), ("image",))
    return links.missing_images(images, paths(spark, sf_dir)).select("unit_id", "file_path", "line_start", "quote", "issue_type")


def stem_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stems of whole texts, and how much of them the halves of a text share."""
    x = files(spark, sf_dir).withColumn("cut", F.expr("cast((length(text) - length(text) % 2) / 2 as int)"))
    halves = (F.expr("substr(text, 1, cut)"), F.expr("substr(text, cut + 1, length(text))"))
    x = once(x, stems=align.stems(F.col("text")), **{c: align.stems(h) for h, c in zip(halves, "ab")})
    return x.select("relative_path", F.md5(F.array_join(F.array_sort("stems"), " ").cast("binary")).alias("stems_md5"), F.size("stems").cast("long").alias("n_stems"), align.jaccard(F.col("a"), F.col("b")).alias("jaccard"))


def fact_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences that state a fact, eight a unit."""
    return context.fact_claims(_lines(spark, sf_dir)).select("unit_id", "k", "claim", "relative_path", "line_no")


QUERIES = {
    q.__name__: q
    for q in (
        editorial_findings, chapter_sequence, label_punctuation, length_conflicts, unconfirmed_paths, resources_without_artifact, call_outputs, foreign_materials,
        curriculum_signals, missing_topics, market_fit, dataset_terms, text_anchors, missing_resources, environment_guides, unit_structure, missing_images, stem_similarity, fact_claims,
    )
}
