"""Queries over the supplied tables, one for each operator that they can show, and their SQL.

Languages stand for locales, (source, number) for message keys, turns of a conversation for snapshots.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from babelyard.functions import lookups as L
from babelyard.functions import text as T
from babelyard.functions.classes import rewrite_token, rewrite_value, utility, variants
from babelyard.functions.tokens import detokenize, tokenize, variables
from babelyard.operators import audit, edits, keys, registry, sync, translate
from babelyard.operators.ranks import numbered
from babelyard.operators.rules import DEFAULT_RULES, Rule
from babelyard.sources import catalogues
from babelyard.sources.css import read_declarations
from babelyard.sources.html import PARSE_ERROR, read_elements
from babelyard.sources.jsontree import read_leaves
from babelyard.sources.scratch import shared_folder
from babelyard.sources.trees import list_tree, read_contents

DEFAULT = "en"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows over four tasks a core. A file of short rows is one split, whatever is made of each row and parsed afterwards; so
    rows are dealt while they are short, in turn, since keys may repeat."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism)


def _catalogue(spark: SparkSession, sf_dir: str, value: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Messages, one for each document: its key is its number among those of its language and source. And the valid keys,
    which are those of labelled documents; every fifth of them asks for a key that no language has yet. value: what a message holds, where the whole text isn't needed."""
    docs = _read(spark, sf_dir, "documents").where("lang is not null and source is not null")
    rows = docs.select(F.col("lang").alias("locale"), "source", "doc_id", F.sha2("text", 256).alias("sha"), (F.col("text") if value is None else value).alias("value"))
    rows = numbered(rows, ["locale", "source"], ["doc_id", "sha"])
    rows = rows.select("doc_id", "locale", F.concat_ws("-", "source", F.col("n").cast("string")).alias("key"), "value")
    labelled = _read(spark, sf_dir, "labels").select("doc_id")
    asked = rows.select("doc_id", F.when(F.col("doc_id") % 5 == 0, F.concat("key", F.lit(".new"))).otherwise(F.col("key")).alias("key"))
    return rows.drop("doc_id"), asked.join(labelled, "doc_id", "left_semi").select("key").distinct()


def _filled() -> Column:
    """What coverage asks of a text: whether there is any."""
    return F.when(F.col("text") == "", "").when(F.col("text").isNotNull(), "x")


def _locales(messages: DataFrame) -> list[str]:
    """The project's locales: as many as there are languages."""
    return sorted(r[0] for r in messages.select("locale").distinct().collect())


# -- catalogues ----------------------------------------------------------------


def coverage_by_lang(spark, sf_dir):
    m, _ = _catalogue(spark, sf_dir, _filled())
    every = m.where(F.col("locale") == DEFAULT).select("key")
    return sync.coverage(sync.coverage_cells(every, m, _locales(m), DEFAULT)).select(F.coalesce("locale", F.lit("all")).alias("locale"), "total", "covered", "filled", F.round("percent", 6).alias("percent"))


def reconciliation_report(spark, sf_dir):
    m, valid = _catalogue(spark, sf_dir, _filled())
    return sync.reconcile(valid, m, _locales(m), DEFAULT)


def new_keys(spark, sf_dir):
    m, valid = _catalogue(spark, sf_dir, _filled())
    return sync.new_keys(valid, m, DEFAULT)


def orphan_keys(spark, sf_dir):
    m, valid = _catalogue(spark, sf_dir, _filled())
    return sync.orphan_keys(valid, m, DEFAULT)


def missing_keys(spark, sf_dir):
    m, valid = _catalogue(spark, sf_dir, _filled())
    return sync.missing_keys(valid, m, _locales(m), DEFAULT)


def write_back_pruned(spark, sf_dir):
    m, valid = _catalogue(spark, sf_dir)
    out = sync.write_back(m, valid, DEFAULT, prune=True)
    return out.select("locale", "key", F.sha2("value", 256).alias("value_hash"))


def seed_locales(spark, sf_dir):
    m, _ = _catalogue(spark, sf_dir)
    fresh = _read(spark, sf_dir, "benchmark").where("text is not null").select(F.concat(F.lit("item-"), F.col("item_id").cast("string")).alias("key"), F.col("text").alias("value"))
    out = sync.seed_locales(m, fresh, _locales(m), DEFAULT)
    return out.select("locale", "key", F.length("value").alias("n_chars"))


def last_wins(spark, sf_dir):
    rows = _read(spark, sf_dir, "conversations").where("text is not null").select(F.col("conv_id").alias("file_order"), F.col("turn").alias("ordinal"), F.col("role").alias("key"), F.col("text").alias("value"))
    return sync.last_wins(rows).select("key", F.sha2("value", 256).alias("value_hash"))


def _snapshot(spark: SparkSession, sf_dir: str, parity: int) -> DataFrame:
    """Turns as values in place: turn 2k is the old and turn 2k + 1 the new value of conversation and k."""
    c = _read(spark, sf_dir, "conversations").where("text is not null").where(F.pmod("turn", F.lit(2)) == parity)
    at = F.concat_ws(".", F.lit("turns"), F.expr("turn div 2").cast("string"))
    return c.select(F.col("conv_id").cast("string").alias("path"), at.alias("dot_path"), F.col("text").alias("value"))


def value_edits(spark, sf_dir):
    out = sync.value_edits(_snapshot(spark, sf_dir, 0), _snapshot(spark, sf_dir, 1))
    return out.select("path", "dot_path", F.sha2("old_key", 256).alias("old_hash"), F.sha2("new_key", 256).alias("new_hash"))


def migrated_messages(spark, sf_dir):
    """Keys of documents' languages moved to another name, as an edit of the key."""
    m, valid = _catalogue(spark, sf_dir)
    moved = valid.select(F.lit("data").alias("path"), F.col("key").alias("dot_path"), F.col("key").alias("old_key"), F.concat(F.col("key"), F.lit("*")).alias("new_key"))
    return sync.migrate(m, moved, DEFAULT).select("locale", "key", F.sha2("value", 256).alias("value_hash"))


def delta_merge(spark, sf_dir):
    m, _ = _catalogue(spark, sf_dir)
    new = m.where(F.length("value") > 1000).select("locale", "key", F.concat(F.lit("new: "), F.col("value")).alias("value"))
    old = m.where(F.length("value") < 3000).select("locale", "key", "value")
    return sync.deep_merge(old, new).select("locale", "key", F.sha2("value", 256).alias("value_hash"))


def incremental_changed(spark, sf_dir):
    """The state knows the even documents, each tenth of them with another content."""
    docs = _read(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"), "doc_id")
    known = docs.where("doc_id % 2 = 0").select("path", F.sha2(F.when(F.col("doc_id") % 20 == 0, F.concat("content", F.lit("x"))).otherwise(F.col("content")), 256).alias("sha256"))
    return sync.changed_files(docs.drop("doc_id"), known).select("path", "sha256")


#: Signs that mean something in a component's markup.
MARKUP = r"""[{}<>&"'`\\]"""


def incremental_sync(spark, sf_dir):
    """Two snapshots of a project through one call each: turns as components, of which every fourth conversation's come later
    only. In the second, every even turn's rewritten source has a paragraph more. Messages of both, by batch."""
    from babelyard.plans.lifecycle import Config
    from babelyard.streaming.incremental import SyncStore, sync_batch

    own = _read(spark, sf_dir, "conversations").where("text is not null")
    path = F.concat(F.lit("src/chats/Chat"), F.concat_ws("x", "conv_id", "turn"), F.lit(".jsx"))
    body = F.concat(F.lit("export default function Chat() {\n    return <div><h1>Say "), F.regexp_replace("text", MARKUP, ""), F.lit("</h1></div>;\n}\n"))
    files = own.select(path.alias("path"), F.lit(".jsx").alias("ext"), body.alias("content"), "conv_id", "turn")
    store, config = SyncStore(spark, f"{shared_folder(spark)}/sync-{uuid.uuid4().hex}"), Config(languages=["en", "ar"])
    early, late = (files.where(f"conv_id % 4 {sign} 0") for sign in ("<>", "="))
    sync_batch(early.drop("conv_id", "turn"), store, 0, config)
    again = early.drop("content").join(store.read("sources", 0), "path")
    edited = F.when(F.col("turn") % 2 == 0, F.replace("content", F.lit("</h1>"), F.lit("</h1><p>More words</p>"))).otherwise(F.col("content"))
    sync_batch(again.withColumn("content", edited).unionByName(late).drop("conv_id", "turn"), store, 1, config)
    sync_batch(early.drop("conv_id", "turn"), store, 1, config)  # a batch that is run again
    return store.read("messages", 0).withColumn("batch", F.lit(0)).unionByName(store.read("messages", 1).withColumn("batch", F.lit(1)))


# -- pages ---------------------------------------------------------------------


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a header, a direction or a viewport put into some, so that scores differ."""
    p = _read(spark, sf_dir, "pages").where("html is not null")
    html = F.when(F.col("page_id") % 2 == 0, F.regexp_replace("html", "<body>", "<body><header></header>")).otherwise(F.col("html"))
    html = F.when(F.col("page_id") % 3 == 0, F.regexp_replace(html, "<html", '<html dir="ltr"')).otherwise(html)
    html = F.when(F.col("page_id") % 5 == 0, F.regexp_replace(html, "<head>", '<head><meta name="viewport" content="x">')).otherwise(html)
    return p.select("page_id", html.alias("html"))


def html_findings_by_code(spark, sf_dir):
    return audit.html_findings(_pages(spark, sf_dir)).groupBy("code").agg(F.count("*").alias("n"))


def html_score_histogram(spark, sf_dir):
    pages = _pages(spark, sf_dir)
    scored = audit.scores(pages, audit.html_findings(pages), "html", "page_id")
    return scored.groupBy("score").agg(F.count("*").alias("n_pages"), F.sum("n_findings").alias("n_findings"))


def html_found_tags(spark, sf_dir):
    return _pages(spark, sf_dir).select(F.explode(audit.html_found_tags(F.col("html"))).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def html_scores_parsed(spark, sf_dir):
    pages = _pages(spark, sf_dir)
    found = audit.html_findings_of_elements(pages.select(F.col("page_id").alias("doc")), read_elements(pages))
    return audit.scores(pages.select(F.col("page_id").alias("doc")), found, "html")


def page_class_tokens(spark, sf_dir):
    own = read_elements(_read(spark, sf_dir, "pages"))
    rows = own.select(F.explode(F.split(F.element_at("attrs", F.lit("class")), r"\s+")).alias("token"))
    return rows.where("token <> ''").groupBy("token").agg(F.count("*").alias("n"))


def page_shown_attributes(spark, sf_dir):
    """Attributes that a reader sees: pages' own, and of a picture that is set into each page, with its url."""
    url = F.regexp_replace("url", MARKUP, "")
    picture = F.concat(F.lit('<body><img alt="Page '), url, F.lit("\" src=x ARIA-LABEL='Show "), url, F.lit("'>"))
    pages = _read(spark, sf_dir, "pages").where("html is not null and url is not null").withColumn("html", F.replace("html", F.lit("<body>"), picture))
    return audit.shown_attributes(read_elements(pages)).groupBy("name", "value").agg(F.count("*").alias("n"))


def page_headings(spark, sf_dir):
    """Pages by how many headings and links they have; those that can't be parsed are told apart. Every seventh page ends in
    a section that no parser knows."""
    pages = _read(spark, sf_dir, "pages").where("html is not null")
    html = F.when(F.col("page_id") % 7 == 0, F.concat("html", F.lit("<![unknown[ x ]]>"))).otherwise(F.col("html"))
    return read_elements(pages.select("page_id", html.alias("html"))).groupBy("doc").agg(F.count_if(F.col("tag").isin("h1", "h2", "h3")).alias("headings"), F.count_if(F.col("tag") == "a").alias("links"), F.max(F.col("tag") == PARSE_ERROR).alias("failed"))


# -- style sheets and classes --------------------------------------------------


def _sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A style sheet for each part: its physical property, side and sizes follow from the part's numbers."""
    p = _dealt(_read(spark, sf_dir, "part").select("p_partkey", "p_size"))
    pick = lambda values, by: F.get(F.array(*(F.lit(v) for v in values)), F.pmod(by, F.lit(len(values))).cast("int"))
    key, px = F.col("p_partkey"), F.concat(F.col("p_size").cast("string"), F.lit("px"))
    side = pick(("left", "right", "center"), key)
    content = F.concat(
        F.lit(".a { "), pick([x[0] for x in L.CSS_PROPS] + ["color"], key), F.lit(": "), px, F.lit("; text-align: "), side,
        F.lit("; float: "), pick(("left", "none", "right"), F.expr("p_partkey div 3")), F.lit(" }\n.b { "), pick(("margin", "padding", "border-radius"), key),
        F.lit(": 1px "), px, F.lit(" 3px"), F.when(key % 2 == 0, " calc(1px + 2px)").otherwise(""), F.when(key % 5 == 0, " !important").otherwise(""), F.lit("; }"),
    )
    return p.select(F.concat(F.lit("src/"), key.cast("string"), F.lit(".css")).alias("path"), content.alias("content"))


def css_findings_by_code(spark, sf_dir):
    return audit.css_findings(read_declarations(_sheets(spark, sf_dir))).groupBy("code").agg(F.count("*").alias("n"))


def css_fixed(spark, sf_dir):
    """Fixed sheets have no finding left."""
    sheets = _sheets(spark, sf_dir)
    fixed = edits.edit_files(sheets, audit.css_edits(read_declarations(sheets)))
    left = audit.css_findings(read_declarations(fixed.select("path", "content")))
    scored = audit.scores(sheets.select(F.col("path").alias("doc")), left, "css")  # every sheet has a fixed one
    return scored.groupBy("score").agg(F.count("*").alias("n"))


def css_fixed_text(spark, sf_dir):
    """The sheets as the fixes leave them."""
    sheets = _sheets(spark, sf_dir)
    return edits.edit_files(sheets, audit.css_edits(read_declarations(sheets))).select("path", "content", "n_edits")


#: A user's own rules beside the fixed ones: colours that are lengths, and any third of a pixel.
USER_RULES = (
    *DEFAULT_RULES,
    Rule("css", "color", "value like '%px'", "FIX_COLOR_LENGTH", 7, "critical", "array(struct('font-size' as prop, value as value), struct('color' as prop, 'inherit' as value))"),
    Rule("jsx", "marginLeft", "value is null", "AVOID_BARE_NUMBER", 3),
)


def user_rules(spark, sf_dir):
    """Findings, points and fixes of the sheets by the fixed rules and a user's."""
    own = read_declarations(_sheets(spark, sf_dir))
    found = audit.with_points(audit.css_findings(own, USER_RULES), "css", USER_RULES)
    return found.groupBy("code", "severity").agg(F.count("*").alias("n"), F.sum("points").alias("points"))


def user_rules_fixed(spark, sf_dir):
    """The first rule of each sheet that is a user's, set into it."""
    sheets = _sheets(spark, sf_dir)
    done = edits.edit_files(sheets, audit.css_edits(read_declarations(sheets), USER_RULES))
    return done.where("content like '%inherit%'").select("path", F.regexp_extract("content", r"^\.a \{ (.*?); text-align", 1).alias("first"))


def user_rules_components(spark, sf_dir):
    """Points of components by the fixed rules and a user's."""
    found = audit.with_points(audit.scan_components(_components(spark, sf_dir), USER_RULES).where("code is not null"), "jsx", USER_RULES)
    return found.groupBy("code").agg(F.count("*").alias("n"), F.sum("points").alias("points"))


def css_property_map(spark, sf_dir):
    """The rules over (property, value) rows, without a sheet around them."""
    p = _read(spark, sf_dir, "part")
    names = F.array(*(F.lit(x[0]) for x in L.CSS_PROPS), F.lit("text-align"), F.lit("float"), F.lit("color"))
    rows = p.select(
        F.lit("x").alias("path"), F.lit(0).alias("ordinal"), F.get(names, F.pmod("p_partkey", F.size(names)).cast("int")).alias("prop"),
        F.when(F.col("p_size") % 2 == 0, "left").otherwise("right").alias("value"),
    ).withColumn("parts", F.array("value"))
    ruled = audit.css_rules(rows).select("prop", "value", F.coalesce("code", F.lit("none")).alias("code"), F.get("fixed", F.lit(0)).alias("f"))
    return ruled.groupBy("prop", "value", "code", F.coalesce("f.prop", "prop").alias("new_prop"), F.coalesce("f.value", "value").alias("new_value")).agg(F.count("*").alias("n"))


TOKENS = tuple(p + "4" for p, _ in L.CLASS_PREFIXES) + ("text-left", "text-right", "flex", "rtl:ml-2")
VARIANT_STEPS = ("", "md:", "hover:", "md:hover:", "print:")


def _class_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A class token for each part: every prefix with supported and unsupported variants."""
    p = _read(spark, sf_dir, "part")
    pick = lambda values, by: F.get(F.array(*(F.lit(v) for v in values)), F.pmod(by, F.lit(len(values))).cast("int"))
    return p.select("p_partkey", F.concat(pick(VARIANT_STEPS, F.expr("p_partkey div 22")), pick(TOKENS, F.col("p_partkey"))).alias("token"))


def class_token_rewrite(spark, sf_dir):
    t = _class_tokens(spark, sf_dir)
    return t.groupBy("token", rewrite_token(F.col("token")).alias("v3"), rewrite_token(F.col("token"), True).alias("v2")).agg(F.count("*").alias("n"))


def class_variants(spark, sf_dir):
    t = _class_tokens(spark, sf_dir)
    return t.groupBy(variants(F.col("token")).alias("variants"), utility(F.col("token")).alias("utility")).agg(F.count("*").alias("n"))


def class_value_rewrite(spark, sf_dir):
    """Whole attributes: an anchor for absolute elements, and a mirror beside translations."""
    t = _class_tokens(spark, sf_dir)
    value = F.concat(F.when(F.col("p_partkey") % 4 == 0, "absolute  ").otherwise(""), F.col("token"), F.when(F.col("p_partkey") % 3 == 0, " -translate-x-2").otherwise(""))
    done = t.select("p_partkey", value.alias("value")).withColumn("r", rewrite_value(F.col("value")))
    return done.select("p_partkey", F.col("r.value").alias("value"), F.col("r.replacements").alias("replacements"), F.col("r.needs_mirror").alias("needs_mirror"))


def class_findings(spark, sf_dir):
    from babelyard.functions.classes import directional_findings

    t = _class_tokens(spark, sf_dir)
    value = F.concat(F.col("token"), F.when(F.col("p_partkey") % 2 == 0, " text-right float-left").otherwise(""))
    return t.select(F.explode(directional_findings(value)).alias("code")).groupBy("code").agg(F.count("*").alias("n"))


# -- texts ---------------------------------------------------------------------


def classify_words_by_lang(spark, sf_dir):
    w = _read(spark, sf_dir, "documents").select("lang", F.explode(F.split("text", " ")).alias("word"))
    return w.groupBy("lang", T.classify(F.col("word"), unicode_space=False).alias("class")).agg(F.count("*").alias("n"))


def text_slug_keys(spark, sf_dir):
    d = _read(spark, sf_dir, "documents").where("text is not null")
    return d.select("doc_id", T.slug(F.regexp_replace("text", "[^ -~]", "")).alias("slug"))


def text_hash_prefix(spark, sf_dir):
    return _read(spark, sf_dir, "documents").where("text is not null").select("doc_id", T.text_hash(F.col("text")).alias("text_hash"))


def duplicate_text_keys(spark, sf_dir):
    d = _read(spark, sf_dir, "documents").where("text is not null")
    by = d.groupBy(T.content_hash(F.col("text")).alias("sha")).agg(F.count("*").alias("n"), F.max("doc_id").alias("last_doc"))
    return by.where("n > 1").select("sha", "n", "last_doc")


def collision_counters(spark, sf_dir):
    """Keys of turns: role as namespace, the whole text's letters as base."""
    c = _read(spark, sf_dir, "conversations").where("text is not null")
    base = F.concat_ws(".", "role", F.lower(F.regexp_replace("text", "[^a-zA-Z]", "")))
    return keys.collision_counters(c.select("conv_id", "turn", "role", base.alias("base")), "role", "base", "conv_id", "turn").select("conv_id", "turn", "key")


def key_allocation(spark, sf_dir):
    """Keys of turns by allocation: each conversation is a file, a turn's role its text's; every tenth
    conversation has its keys from an earlier map."""
    c = _read(spark, sf_dir, "conversations").where("text is not null")
    space = F.concat(F.lit("chat"), F.col("conv_id").cast("string"))
    rows = c.select(
        space.alias("namespace"), F.format_string("%012d", F.col("conv_id")).alias("path"), F.col("turn").cast("int").alias("pos"),
        "text", F.col("turn").cast("string").alias("ast_sig"), F.concat_ws(".", space, "role").alias("base_key"), "conv_id",
    )
    old = rows.where("conv_id % 10 = 0").select("path", T.text_hash(F.col("text")).alias("text_hash"), "ast_sig", F.concat_ws("_", "base_key", F.col("pos").cast("string")).alias("key"))
    return keys.allocate(rows.drop("conv_id"), old).select("path", "pos", "key")


def namespaces(spark, sf_dir):
    """Page paths as source paths: the last two parts give stem and folder."""
    p = _read(spark, sf_dir, "pages").where("url is not null")
    path = F.concat(F.lit("src/"), F.regexp_extract("url", r"/([a-z]+)/[0-9]+", 1), F.lit("/"), F.lit("Page"), F.expr("cast(page_id % 40 as string)"), F.lit(".jsx"))
    return keys.with_namespace(p.select("page_id", path.alias("path"))).select("page_id", "namespace")


def element_roles(spark, sf_dir):
    """The elements of pages with a text, their role or the text's slug, and their index among siblings."""
    found = F.regexp_extract_all("html", F.lit("<(h1|h2|h3|p|li|a|span|td)[^>]*>[^<]+"), F.lit(1))
    texts = F.regexp_extract_all("html", F.lit("<(?:h1|h2|h3|p|li|a|span|td)[^>]*>([^<]+)"), F.lit(1))
    rows = _read(spark, sf_dir, "pages").where("html is not null").select("page_id", F.posexplode(F.arrays_zip(found.alias("tag"), texts.alias("text"))).alias("pos", "e"))
    rows = rows.select("page_id", "pos", F.col("e.tag").alias("tag"), F.regexp_replace("e.text", "[^ -~]", "").alias("text"))
    role = keys.role_part(F.lit(None).cast("string"), F.col("tag"), F.col("text"))
    return rows.groupBy("tag", F.when(role.isin(*set(L.ELEMENT_ROLES.values())), role).otherwise("slug").alias("role")).agg(F.count("*").alias("n"))


def sibling_index(spark, sf_dir):
    c = _read(spark, sf_dir, "conversations").select(F.lit("x").alias("path"), F.col("conv_id").alias("parent"), F.col("role").alias("tag"), F.col("turn").alias("start"))
    return keys.sibling_index(c).select(F.col("parent").alias("conv_id"), F.col("start").alias("turn"), "idx")


def locale_dir(spark, sf_dir):
    d = _read(spark, sf_dir, "documents").where("lang is not null").select(F.when(F.col("doc_id") % 7 == 0, "ar").when(F.col("doc_id") % 7 == 1, "he").otherwise(F.col("lang")).alias("code"))
    return d.groupBy("code", T.locale_dir(F.col("code")).alias("dir"), T.locale_label(F.col("code")).alias("label")).agg(F.count("*").alias("n"))


# -- translation ---------------------------------------------------------------


def _marked(conversations: DataFrame) -> Column:
    return F.concat(F.lit("Hi {{ "), F.col("role"), F.lit(" }} {{{"), F.col("conv_id").cast("string"), F.lit("}}} {{open "), F.col("text"))


def token_roundtrip(spark, sf_dir):
    c = _read(spark, sf_dir, "conversations").where("text is not null")
    rows = c.select("conv_id", "turn", _marked(c).alias("value"))
    rows = rows.select("conv_id", "turn", "value", tokenize(F.col("value")).alias("tokenized"), variables(F.col("value")).alias("vars"))
    return rows.select("conv_id", "turn", "tokenized", F.size("vars").alias("n_vars"), F.get("vars", F.lit(0))["inner"].alias("first_var"), (detokenize(F.col("tokenized"), F.col("vars")) == F.col("value")).alias("same"))


def mock_translate(spark, sf_dir):
    """Through tokens, batches and the provider, for two languages; the full run replaces what they had."""
    c = _read(spark, sf_dir, "conversations").where("text is not null")
    m = c.select(F.lit(DEFAULT).alias("locale"), F.concat_ws(".", "conv_id", "turn").alias("key"), _marked(c).alias("value"))
    return translate.run_translations(m, ["ar", "es"], DEFAULT, translate.MockProvider())


def mock_translate_delta(spark, sf_dir):
    c = _read(spark, sf_dir, "conversations").where("text is not null")
    m = c.select(F.lit(DEFAULT).alias("locale"), F.concat_ws(".", "conv_id", "turn").alias("key"), F.col("text").alias("value"))
    delta = c.where("turn = 0").select(F.concat_ws(".", "conv_id", "turn").alias("key"))
    return translate.run_translations(m, ["ar"], DEFAULT, translate.MockProvider(), delta)


class Silent:
    """A provider that answers nothing."""

    def translate_batch(self, texts: list[str], target: str, source: str) -> list[str | None]:
        raise ConnectionError("no provider")


def translation_memory(spark, sf_dir):
    """Even conversations are translated once, then all of them by a provider that fails: the memory has the first."""
    own = _read(spark, sf_dir, "conversations").where("text is not null")
    key = F.concat_ws(".", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    messages = own.select(F.lit("en").alias("locale"), key.alias("key"), F.col("text").alias("value"), "conv_id")
    memory = translate.TranslationMemory(spark, f"{shared_folder(spark)}/memory-{uuid.uuid4().hex}")
    translate.translate_messages(messages.where("conv_id % 2 = 0").drop("conv_id"), ["ar", "es"], "en", translate.MockProvider(), memory).count()
    again = translate.translate_messages(messages.drop("conv_id"), ["ar", "es"], "en", Silent(), memory)
    return again.select("locale", "key", "value", F.col("error").isNotNull().alias("failed"))


def translation_chunks(spark, sf_dir):
    c = _read(spark, sf_dir, "conversations").select("role", "conv_id", "turn")
    return translate.chunk_numbers(c, "role", "conv_id", "turn").groupBy("role", "chunk").agg(F.count("*").alias("n"), F.min("conv_id").alias("first_conv"))


def answers_by_position(spark, sf_dir):
    """Answers in the source's order; each third is missing and keeps its source."""
    c = _read(spark, sf_dir, "conversations").where("text is not null")
    listed = c.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.col("text").alias("t")))), lambda x: x["t"]).alias("src"))
    answer = F.transform("src", lambda x, k: F.when(k % 3 != 2, F.upper(F.regexp_replace(x, "[^ -~]", ""))))
    return listed.select("conv_id", F.sha2(F.array_join(translate.by_position(F.col("src"), answer), "|"), 256).alias("joined"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every document as a value of a data file, which is the document's source."""
    d = _read(spark, sf_dir, "documents").where("text is not null")
    lines = d.select("doc_id", F.col("source").alias("path"), F.explode(F.split("text", "\n")).alias("value"))
    return lines.select("doc_id", "path", F.lit("title").alias("field"), "value", F.lit(False).alias("error"))


def promote_insert_only(spark, sf_dir):
    """Lines of documents as data values, promoted where the catalogue, the lines of every third one, has no such key."""
    leaves = _lines(spark, sf_dir)
    known = leaves.where("doc_id % 3 = 0").select(F.lit(DEFAULT).alias("locale"), F.col("value").alias("key"))
    return registry.promoted(leaves.drop("doc_id"), known, DEFAULT)


def registry_values_per_file(spark, sf_dir):
    return registry.values_per_file(_lines(spark, sf_dir).drop("doc_id"))


def props_flatten(spark, sf_dir):
    e = _read(spark, sf_dir, "events").where("props is not null").select(F.col("event_id").cast("string").alias("path"), F.concat(F.lit('{"v": {"kind": "'), F.col("event_type"), F.lit('", "list": ["a", {"n": "x"}]}, "p": '), F.col("props"), F.lit("}")).alias("content"))
    return read_leaves(e).groupBy("dot_path", "field", "value").agg(F.count("*").alias("n"))


# -- edits ---------------------------------------------------------------------


def _ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _read(spark, sf_dir, "conversations").where("text is not null")
    start = (F.col("turn") * 4).cast("int")
    return c.select(F.col("conv_id").cast("string").alias("path"), start.alias("start"), (start + 2 + F.pmod(F.length("text"), F.lit(5))).cast("int").alias("end"), F.col("role").alias("replacement"), F.col("turn").alias("ordinal"))


def edit_overlap(spark, sf_dir):
    return edits.overlaps(_ranges(spark, sf_dir)).select("path", "start", "end", "next_end")


def edit_first_of_range(spark, sf_dir):
    rows = _ranges(spark, sf_dir).withColumn("start", (F.col("start") % 8).cast("int")).withColumn("end", (F.col("start") + 3).cast("int"))
    return edits.first_of_each_range(rows)


def edit_apply(spark, sf_dir):
    """Two marks set into every document."""
    d = _read(spark, sf_dir, "documents").where("text is not null")
    e = F.array(*(F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(r).alias("replacement")) for a, b, r in ((2, 4, "<A>"), (10, 10, "<B>"))))
    return d.select("doc_id", F.sha2(edits.apply_edits(F.col("text"), e), 256).alias("edited"))


# -- components: sources written around the tables' values ----------------------


def _components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A component for each turn, with the turn as a text."""
    own = _read(spark, sf_dir, "conversations").where("text is not null")
    name = F.concat_ws("x", "conv_id", "turn")
    first = F.concat(F.lit("Say "), F.trim(F.regexp_replace("text", "[^A-Za-z ]", "")))
    body = F.concat(
        F.lit("export default function Chat() {\n    return (\n        <div className=\"ml-2 flex\" style={{marginLeft: 4}}>\n            <h1>"), first,
        F.lit("</h1>\n            <p>Dear {name}, "), first, F.lit("</p>\n            <p>You have <strong>{count}</strong> mails</p>\n            <p>{format(x)}!</p>\n"),
        F.lit("            <img alt=\"A face\" src=\"a.png\" />\n        </div>\n    );\n}\n"),
    )
    return own.select(F.concat(F.lit("src/chats/Chat"), name, F.lit(".jsx")).alias("path"), F.lit(".jsx").alias("ext"), body.alias("content"))


def jsx_extract(spark, sf_dir):
    from babelyard.operators.extract import extract_units, with_keys

    return with_keys(extract_units(_components(spark, sf_dir))).select("path", "pos", "kind", "value", "key", "reason")


def verified_edits(spark, sf_dir):
    """Components with their style fixes, of which every tenth conversation's have an edit that breaks them."""
    files = _components(spark, sf_dir)
    broken = files.where(r"path rlike '0x[0-9]+[.]jsx$'").select("path", (F.locate("</h1>", "content") - 1).cast("int").alias("start"))
    breaking = broken.select("path", "start", (F.col("start") + 5).alias("end"), F.lit("</h2>").alias("replacement"))
    styled = edits.edit_files(files.select("path", "content"), audit.read_style_edits(files).unionByName(breaking))
    done = edits.verify_edits(files.select("path", "content"), styled)
    return done.select("path", F.sha2("content", 256).alias("content"), "n_edits", "failed")


def jsx_rewrite_scores(spark, sf_dir):
    """Components before and after the style fixes."""
    from babelyard.plans.lifecycle import audit_project, fix_styles

    files = _components(spark, sf_dir)
    fixed = fix_styles(files).join(files.select("path", "ext"), "path").select("path", "ext", "content")
    before = audit_project(files).groupBy("score").agg(F.count("*").alias("n")).withColumn("when", F.lit("before"))
    return before.unionByName(audit_project(fixed).groupBy("score").agg(F.count("*").alias("n")).withColumn("when", F.lit("after")))


def class_report(spark, sf_dir):
    from babelyard.plans.lifecycle import class_report as report

    return report(_components(spark, sf_dir))


# -- projects ------------------------------------------------------------------


def _projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A project for each customer, whose dependencies follow from its key."""
    c = _read(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    dep = lambda name, by, values: F.when(k % by == 0, F.concat(F.lit(f'"{name}":"'), F.get(F.array(*(F.lit(v) for v in values)), (F.floor(k / by) % len(values)).cast("int")), F.lit('"')))
    deps = F.concat_ws(",", dep("react", 1, ("^15.1.0", "^18.2.0", "~17.0")), dep("typescript", 2, ("^4.9", "^5.3.0")), dep("next", 3, ("12.1", "^14.0")), dep("next-intl", 5, ("1",)), dep("next-i18next", 7, ("1",)), dep("tailwindcss", 4, ("^2.2", "^3.4", ">=4.0", "latest")))
    files = F.filter(F.array(F.when(k % 3 == 0, F.lit("next.config.js")), F.when(k % 4 == 0, F.lit("tailwind.config.ts")), F.when(k % 8 == 0, F.lit("src/index.css"))), lambda x: x.isNotNull())
    return c.select(
        k.cast("string").alias("project"), F.concat(F.lit('{"dependencies":{'), deps, F.lit("}}")).alias("package"), F.when(k % 11 == 0, "experimental: { appDir: true }").alias("next_config"),
        F.when(k % 13 == 0, "pages-router").when(k % 17 == 0, "other").alias("flag"), (k % 2 == 0).alias("has_app"), (k % 6 < 2).alias("has_pages"), (k % 2 == 0).alias("has_layout"), (k % 6 == 0).alias("has_pages_app"), files.alias("files"),
    )


def project_adapter(spark, sf_dir):
    from babelyard.plans import facts

    return facts.adapter(_projects(spark, sf_dir)).groupBy(F.coalesce("name", F.lit("-")).alias("name"), F.coalesce("reason", F.lit("-")).alias("reason"), F.coalesce("error", F.lit("-")).alias("error")).agg(F.count("*").alias("n"))


def catalogue_paths(spark, sf_dir):
    """The files that a message of each project goes to, by the project's adapter."""
    from babelyard.plans import facts

    own = _read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("project"), F.lit("en").alias("locale"), F.lit("customer").alias("key"), F.col("c_name").alias("value"))
    return catalogues.with_paths(own, facts.adapter(_projects(spark, sf_dir)))


def catalogue_files(spark, sf_dir):
    """Every document as a message of its language: a project's catalogue, written as files in both places and read back."""
    docs = _read(spark, sf_dir, "documents")
    messages = docs.select(F.lit("").alias("project"), F.col("lang").alias("locale"), F.col("doc_id").cast("string").alias("key"), F.col("text").alias("value"))
    adapters = spark.createDataFrame([("", "next-i18next")], "project string, name string")
    root = f"{shared_folder(spark)}/catalogue-{uuid.uuid4().hex}"
    done = catalogues.write_projects(messages, adapters, root)
    return catalogues.read_catalogues(spark, root, done).select("file", "locale", "key", F.sha2("value", 256).alias("value_hash"))


def project_environment(spark, sf_dir):
    from babelyard.plans import facts

    return facts.environment(_projects(spark, sf_dir)).groupBy("status", F.coalesce("i18next", F.lit("-")).alias("i18next"), F.col("next_note").isNotNull().alias("noted")).agg(F.count("*").alias("n"))


def project_tailwind(spark, sf_dir):
    from babelyard.plans import facts

    t = facts.tailwind(_projects(spark, sf_dir))
    return t.groupBy("has_tailwind", F.coalesce("version", F.lit(0)).alias("version"), F.coalesce("config_path", F.lit("-")).alias("config_path"), F.coalesce("css_entry_path", F.lit("-")).alias("css_entry_path")).agg(F.count("*").alias("n"))


def project_frameworks(spark, sf_dir):
    from babelyard.plans import facts

    return facts.frameworks(_projects(spark, sf_dir)).groupBy("is_next").agg(F.count("*").alias("n"))


def snapshot_history(spark, sf_dir):
    """Turns as snapshots of a value for each conversation: where every text has moved to in the end."""
    own = _read(spark, sf_dir, "conversations").where("text is not null")
    snapshots = own.select(F.col("turn").alias("step"), F.col("conv_id").cast("string").alias("path"), F.lit("v").alias("dot_path"), F.col("text").alias("value"))
    return sync.moved_keys(sync.history_edits(snapshots))


# -- file trees ----------------------------------------------------------------


def pruned_scan(spark, sf_dir):
    """Every document as a line of a file, in folders by source and language; read back without the folders of one language,
    which aren't opened, and without files of other endings."""
    docs = _read(spark, sf_dir, "documents").select(F.to_json(F.struct("doc_id", "text")).alias("value"), "source", "lang")
    root = f"{shared_folder(spark)}/tree-{uuid.uuid4().hex}"
    docs.write.partitionBy("source", "lang").option("maxRecordsPerFile", 200).text(root)
    found = read_contents(list_tree(spark, [root], pruned=["lang=de"], endings=[".txt"]))
    lines = found.select(F.explode(F.split("content", "\n")).alias("line"))
    own = lines.select(F.from_json("line", "doc_id long, text string").alias("d")).where("d.doc_id is not null")
    return own.select("d.doc_id", F.sha2("d.text", 256).alias("text_hash"))


def static_keys(spark, sf_dir):
    """Keys that the sources of turns ask for: literal ones in calls and in rich texts, no computed ones."""
    from babelyard.operators import extract

    own = _read(spark, sf_dir, "conversations").where("text is not null and role is not null")
    code = F.concat(
        F.lit("export default function Chat() {\n    return <div title={t('chat."), F.col("role"), F.lit("')}>{t(`of ${name}`)}{t(key)}<Trans i18nKey=\"rich."),
        F.col("turn").cast("string"), F.lit("\">"), F.regexp_replace("text", MARKUP, ""), F.lit("</Trans>{other('no.key')}</div>;\n}\n"),
    )
    files = own.select(F.concat_ws("x", "conv_id", "turn").alias("path"), code.alias("content"))
    return extract.static_keys(files).groupBy("key").agg(F.count("*").alias("n"))


def language_arrays(spark, sf_dir):
    """Written-out lists of a project's languages in sources, each with another list or another way to write it."""
    from babelyard.plans import facts

    c = _read(spark, sf_dir, "customer")
    pick = lambda *values: F.get(F.array(*(F.lit(v) for v in values)), (F.col("c_custkey") % len(values)).cast("int"))
    content = F.concat(F.lit("export const own = "), pick("['en', 'ar']", '[ "en" ,"ar" ]', "['ar', 'en']", "['en', 'ar', 'fr']", "['en',\n 'ar']"), F.lit("; // "), F.col("c_name"))
    files = c.select(F.concat(pick("src/a", "src/i18n/locales."), F.col("c_custkey").cast("string"), F.lit(".js")).alias("path"), content.alias("content"))
    return facts.language_arrays(files, ["en", "ar"]).select("path", "found")


QUERIES = {
    f.__name__: f
    for f in (
        coverage_by_lang, reconciliation_report, new_keys, orphan_keys, missing_keys, write_back_pruned, seed_locales, last_wins, value_edits,
        migrated_messages, delta_merge, incremental_changed, incremental_sync, html_findings_by_code, html_score_histogram, html_found_tags, html_scores_parsed,
        page_class_tokens, page_shown_attributes, page_headings, css_findings_by_code, css_fixed, css_fixed_text, user_rules, user_rules_fixed, user_rules_components, css_property_map, class_token_rewrite, class_variants,
        class_value_rewrite, class_findings, classify_words_by_lang, text_slug_keys, text_hash_prefix, duplicate_text_keys, collision_counters,
        key_allocation, namespaces, element_roles, sibling_index, locale_dir, token_roundtrip, mock_translate, mock_translate_delta,
        translation_memory, translation_chunks, answers_by_position, promote_insert_only, registry_values_per_file, props_flatten, edit_overlap, edit_first_of_range,
        edit_apply, jsx_extract, verified_edits, jsx_rewrite_scores, class_report, project_adapter, catalogue_paths, catalogue_files, project_environment, project_tailwind, project_frameworks,
        snapshot_history, pruned_scan, static_keys, language_arrays,
    )
}
