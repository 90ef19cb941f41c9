"""Conversations in a key-value store: composers, the bubbles that they refer to, and the gates of a store.

``items`` are rows (path, key, value) as ``stores.key_range`` gives them. A bubble's text counts as the user's own only if it agrees with the state of the
editor beside it (``editor_states``); ``outcome`` says why a bubble is no prompt of the user, ``gate`` how a prompt agrees. A store of which too
many rows are odd gives no text at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, text
from ..operators.common import materialize
from ..operators.states import Scan
from . import editor_states
from .formats import BUBBLE, BUBBLE_VERSION, COMPOSER, COMPOSER_VERSIONS, LEAKS, MALFORMED_SHARE, MISMATCH_SHARE, MISSING_SHARE, ODD_VERSION_SHARE, USER, VERBATIM_GATES
from .records import elements, is_array, is_object, is_true, kind, string, strip


def whole_number(v: Column, path: str) -> Column:
    return F.when(kind(v, path) == "BIGINT", F.variant_get(v, path, "long"))


def composers(items: DataFrame) -> DataFrame:
    """By composer: class (malformed, id_mismatch, embedded, unsupported_version, current), version, time, the ids of its sub-composers and of the user's bubbles."""
    v = F.col("v")
    rows = items.where(F.col("key").startswith(COMPOSER)).select("path", F.substring("key", len(COMPOSER) + 1, 1 << 20).alias("composer_id"), F.try_parse_json("value").alias("v"))
    version = whole_number(v, "$._v")
    embedded = (is_object(v, "$.conversationMap") & (F.size(F.expr("json_object_keys(to_json(variant_get(v, '$.conversationMap', 'variant')))")) > 0)) | is_array(v, "$.conversation")
    what = (
        F.when(~is_object(v, "$"), "malformed").when(~string(v, "$.composerId").eqNullSafe(F.col("composer_id")), "id_mismatch").when(version.isNull(), "malformed")
        .when(F.coalesce(embedded, F.lit(False)), "embedded").when(~version.between(*COMPOSER_VERSIONS), "unsupported_version").otherwise("current")
    )
    own = F.transform(F.filter(elements(v, "$.fullConversationHeadersOnly"), lambda h: whole_number(h, "$.type").eqNullSafe(F.lit(USER)) & string(h, "$.bubbleId").isNotNull()), lambda h: F.variant_get(h, "$.bubbleId", "string"))
    subs = F.transform(F.filter(elements(v, "$.subComposerIds"), lambda h: kind(h, "$") == "STRING"), lambda h: F.variant_get(h, "$", "string"))
    created = text.epoch_ms(F.when(kind(v, "$.createdAt").isin("BIGINT", "DOUBLE"), F.variant_get(v, "$.createdAt", "double")))
    return rows.select("path", "composer_id", what.alias("class"), version.alias("version"), created.alias("created_at"), is_true(v, "$.isBestOfNSubcomposer").alias("best_of_n"), subs.alias("sub_ids"), own.alias("bubble_ids"))


def bubbles(items: DataFrame) -> DataFrame:
    """By bubble its outcome, in the order of the tests, its stored text, its gate, what of the text is the user's own, version, time and flags."""
    v = F.col("v")
    rows = items.where(F.col("key").startswith(BUBBLE)).select("path", F.split("key", ":")[1].alias("composer_id"), F.split("key", ":")[2].alias("bubble_id"), F.try_parse_json("value").alias("v"))
    version, body = whole_number(v, "$._v"), string(v, "$.text")
    leak = F.lit(False)
    for x in LEAKS:
        leak = leak | F.ltrim(body).startswith(x)
    outcome = (
        F.when(~is_object(v, "$") | version.isNull(), "malformed").when(version != BUBBLE_VERSION, "unsupported_version").when(~whole_number(v, "$.type").eqNullSafe(F.lit(USER)), "excluded_role")
        .when(is_true(v, "$.isNudge"), "excluded_nudge").when(is_true(v, "$.isQuickSearchQuery"), "excluded_quick_search").when(is_true(v, "$.skipRendering"), "excluded_skip_rendering")
        .when(F.coalesce(strip(body), F.lit("")) == "", "excluded_empty").when(leak, "wrapper_leak").otherwise("kept")
    )
    rows = rows.select("path", "composer_id", "bubble_id", outcome.alias("outcome"), version.alias("bubble_version"), body.alias("text"), text.iso_timestamp(string(v, "$.createdAt")).alias("ts"), string(v, "$.richText").alias("rich"))
    state = rows.withColumn("state", F.when(F.col("outcome") == "kept", editor_states.projection(F.col("rich")))).drop("rich")
    judged = state.withColumn("gate", F.when(F.col("outcome") == "kept", editor_states.gate(F.col("text"), F.col("state"))))
    judged = judged.withColumn("own_text", F.when(F.col("gate").isin(*VERBATIM_GATES), editor_states.without_mentions(F.col("text"), F.col("state.names"))))
    stripped = F.coalesce(F.col("own_text") != F.col("text"), F.lit(False))
    unknown = F.coalesce(F.size("state.unknown") > 0, F.lit(False))
    flags = F.array_compact(F.array(F.when(stripped, F.lit("mention_stripped")), F.when(F.length("text") > fixed.LONG_PASTE_CHARS, F.lit("possible_paste")), F.when(unknown, F.lit("unknown_lexical_node"))))
    return judged.select("path", "composer_id", "bubble_id", "outcome", "bubble_version", "text", "gate", "own_text", "ts", flags.alias("flags"))


def eligible(found: DataFrame) -> DataFrame:
    """Current composers that are nobody's sub-composer nor one of several tries."""
    subs = found.select("path", F.explode("sub_ids").alias("composer_id")).distinct()
    return found.where("class = 'current' and not best_of_n").join(subs, ["path", "composer_id"], "left_anti")


def referenced(found: DataFrame, own: DataFrame) -> DataFrame:
    """The bubbles that eligible composers name, ``missing`` where the store has none, and ``gone`` where their composer misses over a tenth of them."""
    refs = eligible(found).select("path", "composer_id", "created_at", F.posexplode("bubble_ids").alias("place", "bubble_id"))
    rows = refs.join(own, ["path", "composer_id", "bubble_id"], "left").withColumn("missing", F.col("outcome").isNull())
    gone = rows.groupBy("path", "composer_id").agg((F.count_if("missing") * MISSING_SHARE > F.count("*")).alias("gone")).where("gone")
    return rows.join(gone, ["path", "composer_id"], "left").withColumn("gone", F.col("gone").isNotNull())


def _counters() -> Scan:
    """What a store is judged by; each field merges, so that stores are scanned in parts."""
    of = lambda x, *values: (F.col("kind") == x) & F.col("what").isin(*values)
    bubble, live = F.col("kind") == "bubble", of("bubble", "kept") & ~F.col("gone")
    gated = lambda *values: live & F.col("gate").isin(*values)
    own = F.when(gated(*VERBATIM_GATES) & (strip(F.col("own_text")) != ""), F.col("own_text"))
    return Scan(
        sums={
            "composers": F.col("kind") == "composer", **{k: of("composer", k) for k in ("current", "embedded", "unsupported_version", "id_mismatch", "malformed")}, "best_of_n": F.col("best_of_n"), "sub_composers": F.col("sub"),
            "referenced": bubble, "missing": bubble & F.col("what").isNull(), "fetched": bubble & F.col("what").isNotNull(), **{f"bubbles_{k}": of("bubble", k) for k in ("malformed", "unsupported_version", "excluded_role", "excluded_nudge", "excluded_quick_search", "excluded_skip_rendering", "excluded_empty", "wrapper_leak")},
            "kept": live, "verbatim": gated(*VERBATIM_GATES), **{k: gated(k) for k in ("verbatim_exact", "verbatim_whitespace", "verbatim_mention_sigil", "no_editor_state", "text_projection_mismatch")},
            **{f: live & F.array_contains("flags", f) for f in ("mention_stripped", "possible_paste", "unknown_lexical_node")}, "mention_only": gated(*VERBATIM_GATES) & own.isNull(),
            "candidate_words": F.when(live, text.count_words(F.col("text"))), "candidate_bytes": F.when(live, F.octet_length("text")), "analyzable": own.isNotNull(), "analyzable_words": text.count_words(own), "analyzable_bytes": F.octet_length(own),
        },
        least={"earliest": F.when(live, F.col("ts"))}, greatest={"latest": F.when(live, F.col("ts"))},
        sets={"composer_versions": F.when(F.col("kind") == "composer", F.col("version")), "bubble_versions": F.when(bubble, F.col("version"))},
    )


def facts(items: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """One row for each composer and for each bubble that an eligible one names, as ``store_scan`` counts them; ``rows``: what ``referenced`` has given, if it is there already."""
    found = composers(items)
    subs = found.select("path", F.explode("sub_ids").alias("composer_id")).distinct().withColumn("named", F.lit(True))
    current = F.col("class") == "current"
    heads = found.join(subs, ["path", "composer_id"], "left").select(
        "path", "composer_id", F.lit("composer").alias("kind"), F.col("class").alias("what"), F.when(F.col("class").isin("current", "unsupported_version"), F.col("version")).alias("version"),
        (current & F.col("best_of_n")).alias("best_of_n"), (current & ~F.col("best_of_n") & F.col("named").isNotNull()).alias("sub"),
    )
    rows = referenced(found, bubbles(items)) if rows is None else rows
    own = rows.select("path", "composer_id", F.lit("bubble").alias("kind"), F.col("outcome").alias("what"), F.col("bubble_version").alias("version"), "gone", "gate", "text", "own_text", F.coalesce("ts", "created_at").alias("ts"), "flags")
    return heads.unionByName(own, allowMissingColumns=True)


def store_scan(rows: DataFrame, *keys: str) -> DataFrame:
    return _counters().of(rows, *(keys or ("path",)))


def merged_scans(states: DataFrame, *keys: str) -> DataFrame:
    return _counters().merged(states, *(keys or ("path",)))


def judged_scan(states: DataFrame) -> DataFrame:
    """``supported``: not too many bubbles malformed, of another version or at odds with their editor states, no leak of request context, some current composer."""
    drift = F.col("text_projection_mismatch") * MISMATCH_SHARE > F.col("verbatim") + F.col("text_projection_mismatch")
    odd = (F.col("bubbles_malformed") * MALFORMED_SHARE > F.col("fetched")) | (F.col("bubbles_unsupported_version") * ODD_VERSION_SHARE > F.col("fetched")) | (F.col("bubbles_wrapper_leak") > 0) | ((F.col("composers") > 0) & (F.col("current") == 0))
    consistent = F.col("verbatim") + F.col("no_editor_state") + F.col("text_projection_mismatch") == F.col("kept")
    return states.withColumn("drifted", drift).withColumn("supported", ~(odd | drift)).withColumn("consistent", consistent)


def store_gate(items: DataFrame) -> DataFrame:
    """By store its counters and verdict."""
    return judged_scan(store_scan(facts(items)))


def utterances(items: DataFrame) -> DataFrame:
    """The reconciled prompts of supported stores, less their mentions."""
    # Written, as the verdict on a store and its texts both need the judged bubbles; a filter above their columns would write out all expressions again, too.
    rows = materialize(referenced(composers(items), bubbles(items)), "bubbles")
    gate = judged_scan(store_scan(facts(items, rows))).where("supported").select("path")
    kept = rows.where("outcome = 'kept' and not gone").where(F.col("gate").isin(*VERBATIM_GATES) & (strip(F.col("own_text")) != ""))
    return kept.join(gate, "path").select("path", "composer_id", "bubble_id", "place", F.col("own_text").alias("text"), "gate", F.coalesce("ts", "created_at").alias("ts"), "flags")
