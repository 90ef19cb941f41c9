"""Texts of serialized editor states, and whether a stored prompt is what its editor state says.

A state is a tree of nodes in JSON. It is projected within its row, by column expressions: level after level the children of a frontier of nodes are taken out, each with
its path of ordinals; leaves become parts of the text, and the parts in the order of their paths are the text. The number of levels is bounded by the
braces in the JSON, so a tree may be of any depth; no row leaves the JVM or meets another one.

``reconciled`` compares a prompt with its projection: as it is, with white space made equal, and without the sigils of mentions. Only a
prompt that agrees in one of these ways is its user's own text, less its mentions: names with a sigil go everywhere, bare ones at most as often
as the tree mentions them, longer names first.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import formats
from .records import VISIBLE, _WS, elements, is_array, is_object, kind, string, strip

_PART = "array<struct<path: array<int>, text: string, mention: boolean>>"
_FRONTIER = "array<struct<path: array<int>, node: variant>>"


def _none(ddl: str) -> Column:
    return F.expr(f"cast(array() as {ddl})")


def mention_name(node: Column) -> Column:
    """The first of the keys for a display name that holds a visible string; empty if none does."""
    return F.coalesce(*[F.when(F.coalesce(string(node, f"$.{k}").rlike(VISIBLE), F.lit(False)), string(node, f"$.{k}")) for k in formats.MENTION_NAME_KEYS], F.lit(""))


def _rendered(node: Column) -> Column:
    """What a leaf adds to the text; null for a node that its children stand for."""
    what = string(node, "$.type")
    return F.when(what == "text", F.coalesce(string(node, "$.text"), F.lit(""))).when(what == "tab", "\t").when(what == "linebreak", "\n").when(what == "mention", mention_name(node))


def _deeper(state: Column) -> Column:
    """One level: leaves of the frontier become parts, the children of all others are the next frontier."""
    objects = F.filter(state["frontier"], lambda x: is_object(x["node"], "$"))
    leaves = F.filter(objects, lambda x: _rendered(x["node"]).isNotNull())
    inner = F.filter(objects, lambda x: _rendered(x["node"]).isNull())
    parts = F.transform(leaves, lambda x: F.struct(x["path"].alias("path"), _rendered(x["node"]).alias("text"), (string(x["node"], "$.type") == "mention").alias("mention")))
    below = F.flatten(F.transform(inner, lambda x: F.transform(elements(x["node"], "$.children"), lambda c, i: F.struct(F.concat(x["path"], F.array(i)).alias("path"), c.alias("node")))))
    odd = F.filter(F.transform(inner, lambda x: F.coalesce(string(x["node"], "$.type"), F.lit("<untyped>"))), lambda t: ~t.isin(*formats.NODE_TYPES))
    next_state = F.struct(below.cast(_FRONTIER).alias("frontier"), F.concat(state["parts"], parts.cast(_PART)).alias("parts"), F.array_union(state["unknown"], odd).alias("unknown"))
    return F.when(F.size(state["frontier"]) == 0, state).otherwise(next_state)


def projection(rich_text: Column) -> Column:
    """struct(text, names, unknown) of an editor state: its text, the names of its mentions in their order, and its unknown node types; null without a usable state."""
    v = F.try_parse_json(rich_text)
    children = elements(v, "$.root.children")
    usable = F.coalesce(rich_text.rlike(VISIBLE), F.lit(False)) & is_object(v, "$") & is_object(v, "$.root") & is_array(v, "$.root.children") & (F.size(children) > 0)
    root = F.when(kind(v, "$.root.type").isNotNull() & (kind(v, "$.root.type") != "VOID"), F.coalesce(string(v, "$.root.type"), F.lit("<untyped>")))
    odd_root = F.filter(F.array(root), lambda t: t.isNotNull() & (t != "root"))
    # A root's child has the path [i, 0]; the line feed before it has [i] and so comes first.
    feeds = F.transform(children, lambda c, i: F.struct(F.array(i).alias("path"), F.when(i > 0, "\n").otherwise("").alias("text"), F.lit(False).alias("mention")))
    start = F.struct(F.transform(children, lambda c, i: F.struct(F.array(i, F.lit(0)).alias("path"), c.alias("node"))).cast(_FRONTIER).alias("frontier"), feeds.cast(_PART).alias("parts"), odd_root.cast("array<string>").alias("unknown"))
    levels = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(rich_text) - F.length(F.replace(rich_text, F.lit("{"), F.lit("")))))
    done = F.aggregate(levels, start, lambda state, _: _deeper(state))
    # Paths differ, so parts are ordered by them alone.
    whole = F.transform(F.array(done), lambda d: F.struct(F.array_sort(d["parts"]).alias("parts"), d["unknown"].alias("unknown")))[0]
    made = F.transform(F.array(whole), lambda w: F.struct(
        F.array_join(F.transform(w["parts"], lambda p: p["text"]), "").alias("text"),
        F.transform(F.filter(w["parts"], lambda p: p["mention"] & (p["text"] != "")), lambda p: p["text"]).alias("names"),
        F.array_sort(w["unknown"]).alias("unknown"),
    ))[0]
    return F.when(usable, made)


def squeezed(x: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return strip(F.regexp_replace(x, f"{_WS}+", " "))


def longest_first(names: Column) -> Column:
    return F.transform(F.array_sort(F.transform(F.array_distinct(names), lambda n: F.struct((-F.length(n)).alias("l"), n.alias("n")))), lambda s: s["n"])


def without_sigils(text: Column, names: Column) -> Column:
    """The text with ``@name`` as ``name``."""
    return F.aggregate(longest_first(names), text, lambda t, n: F.replace(t, F.concat(F.lit("@"), n), n))


def _count(text: Column, part: Column) -> Column:
    return ((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).cast("int")


def _cut_first(text: Column, part: Column) -> Column:
    """The text without the first occurrence of the part."""
    at = F.position(part, text)
    return F.when(at > 0, F.concat(F.substring(text, F.lit(1), at - 1), F.substring(text, at + F.length(part), F.length(text)))).otherwise(text)


def without_mentions(text: Column, names: Column) -> Column:
    """The text less its mentions; where any went, runs of blanks and tabs become one space and lines lose the white space at their ends."""

    def step(t: Column, n: Column) -> Column:
        sigil = F.concat(F.lit("@"), n)
        budget = F.size(F.filter(names, lambda x: x == n)) - _count(t, sigil)
        bare = F.when(budget > 0, F.sequence(F.lit(1), budget)).otherwise(_none("array<int>"))
        return F.aggregate(bare, F.replace(t, sigil, F.lit("")), lambda left, _: _cut_first(left, n))

    gone = F.aggregate(longest_first(names), text, step)
    lines = F.transform(F.split(F.regexp_replace(gone, "[ \t]{2,}", " "), "\n", -1), strip)
    return F.when(gone == text, text).otherwise(strip(F.array_join(lines, "\n")))


def gate(text: Column, state: Column) -> Column:
    """How a prompt agrees with the projection of its editor state."""
    plain = without_sigils(text, state["names"])
    return (
        F.when(state.isNull(), "no_editor_state").when(text == state["text"], "verbatim_exact").when(squeezed(text) == squeezed(state["text"]), "verbatim_whitespace")
        .when((plain == state["text"]) | (squeezed(plain) == squeezed(state["text"])), "verbatim_mention_sigil").otherwise("text_projection_mismatch")
    )
