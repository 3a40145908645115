"""Prompts put together from templates, the parts of a card and of a scenario, and a guide by type.

Texts are the caller's: templates are rows, guides a table, so that wording changes without
code. ``{name}`` in a template stands for a value of that name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mosaiq.functions import text as T
from mosaiq.operators.selection import DEFAULT_TYPE, TAG_TYPES


def filled(template: Column, values: dict[str, Column]) -> Column:
    """A template with each ``{name}`` replaced by its value, null by the empty string; names without a value stay.

    The template is cut around its names first, so a value that itself holds a ``{name}`` is
    not filled again.
    """

    def piece(x: Column) -> Column:
        found = F.when(F.lit(False), "")
        for name, value in values.items():
            found = found.when(x == f"{{{name}}}", F.coalesce(value.cast("string"), F.lit("")))
        return found.otherwise(x)

    return F.array_join(F.transform(F.split(F.coalesce(template, F.lit("")), "(?<=\\})|(?=\\{)"), piece), "")


def bullets(items: Column, mark: str = "  * ") -> Column:
    """A list as lines; null items are left out."""
    return F.array_join(F.transform(F.array_compact(items), lambda x: F.concat(F.lit(mark), x)), "\n")


def type_of(tag: Column) -> Column:
    """The type that a tag stands for; unknown and missing tags have the default one."""
    return T.lookup(tag, TAG_TYPES, DEFAULT_TYPE)


def system_prompts(panel: DataFrame, sections: list[tuple[int, str]], guides: DataFrame, values: dict[str, Column], tag: str = "tag") -> DataFrame:
    """``panel`` with ``type`` and ``prompt``: the sections in order of their numbers, joined by empty lines.

    ``guides`` has ``type`` and text columns, one row a type; a section may name those
    columns as well as ``values``. So a prompt has the one guide of its card's type.
    Rows whose type has no guide keep its places empty.
    """
    texts = [c for c in guides.columns if c != "type"]
    rows = panel.withColumn("type", type_of(F.col(tag))).join(F.broadcast(guides.select(F.col("type").alias("__type"), *(F.col(c).alias(f"__{c}") for c in texts))), F.col("type") == F.col("__type"), "left")  # a row a type
    known = {**{c: F.col(f"__{c}") for c in texts}, **values}
    parts = [filled(F.lit(text), known) for _, text in sorted(sections)]
    return rows.withColumn("prompt", F.concat_ws("\n\n", *parts)).drop("__type", *(f"__{c}" for c in texts))


def user_prompts(requests: DataFrame, utterance: str, answer: str, opening: str, values: dict[str, Column]) -> DataFrame:
    """``requests`` with ``user_prompt``: ``answer`` filled where there is an utterance, else ``opening``."""
    said = F.coalesce(F.col(utterance), F.lit("")) != ""
    return requests.withColumn("user_prompt", F.when(said, filled(F.lit(answer), values)).otherwise(filled(F.lit(opening), values)))


def table_answers(panel: DataFrame, answers: DataFrame, tag: str = "tag") -> DataFrame:
    """``panel`` with ``type`` and ``text``: the answer that ``answers`` (``type, text``) has for the card's type, or else the default type's."""
    typed = panel.withColumn("type", type_of(F.col(tag)))
    known = F.broadcast(answers.select(F.col("type").alias("__type"), F.col("text").alias("__text")))  # a row a type
    usual = F.broadcast(answers.where(F.col("type") == DEFAULT_TYPE).agg(F.first("text").alias("__usual")))  # one row
    return typed.join(known, F.col("type") == F.col("__type"), "left").crossJoin(usual).withColumn("text", F.coalesce("__text", "__usual")).drop("__type", "__text", "__usual")
