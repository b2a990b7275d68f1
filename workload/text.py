"""Query text functions over the bound query logs, and label rules over the catalog texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from forage.functions import fixed, labels, text
from forage.functions.display import named
from forage.sources.catalog import label_catalog as label_documents
from forage.sources.food import synonym_forms as forms_of
from workload import sql
from workload.bindings import ctes, table, view, words
from workload.registry import query

LOG = ctes("query_log")
CJK_LOG = ctes("cjk_log")
TOKENS = LOG + f", t AS (SELECT query_id, q, requested, {sql.latin_tokens(sql.squish('q'))} AS tokens FROM query_log)"


def _log(spark, sf_dir):
    return view(spark, sf_dir, "query_log")


def _joined(column):
    return F.array_join(column, ",")


@query(
    "detect_language",
    LOG + ", logs AS (SELECT 'a' AS log, query_id, q FROM query_log UNION ALL SELECT 'b', query_id, q FROM cjk_log) ".replace(", logs", ", " + CJK_LOG[5:] + ", logs")
    + "SELECT log, query_id, CASE WHEN len(regexp_extract_all(q, '[一-鿿]')) / greatest(len(q), 1) > 0.3 THEN 'zh' ELSE 'en' END AS language FROM logs",
)
def detect_language(spark, sf_dir):
    both = _log(spark, sf_dir).select(F.lit("a").alias("log"), "query_id", "q").unionByName(
        view(spark, sf_dir, "cjk_log").select(F.lit("b").alias("log"), "query_id", "q")
    )
    return both.select("log", "query_id", text.detect_language(F.col("q")).alias("language"))


@query("query_tokens", TOKENS + "SELECT query_id, array_to_string(tokens, ',') AS tokens FROM t")
def query_tokens(spark, sf_dir):
    return _log(spark, sf_dir).select("query_id", _joined(text.query_tokens(F.col("q"))).alias("tokens"))


_DICTIONARY = list(
    dict.fromkeys(
        [f for forms in fixed.DIET_SYNONYMS.values() for f in forms if "一" <= f[0] <= "鿿"]
        + [c for name in fixed.CUISINE_NAMES.values() for c in name.split("/")]
    )
)


@query(
    "zh_tokens",
    CJK_LOG + f""", p AS (SELECT query_id, q,
      list_sort(list_transform(list_filter({sql.strings(_DICTIONARY)}, lambda f: contains(q, f)), lambda f: {{'a': position(f IN q), 'f': f}})) AS placed,
      flatten(list_transform(regexp_extract_all(q, '[一-鿿]+|[A-Za-z0-9]+'), lambda w: CASE WHEN regexp_matches(w, '^[一-鿿]+$')
        THEN list_transform(range(1, greatest(len(w), 2)), lambda k: substring(w, k, 2)) ELSE [w] END)) AS pieces FROM cjk_log),
    a AS (SELECT query_id, list_concat(list_transform(placed, lambda x: x.f), pieces) AS every FROM p)
    SELECT query_id, array_to_string(list_filter({sql.ordered_distinct('every')}, lambda t: t NOT IN {sql.in_list(fixed.STOPWORDS_ZH)}), ',') AS tokens FROM a""",
)
def zh_tokens(spark, sf_dir):
    return view(spark, sf_dir, "cjk_log").select("query_id", _joined(text.cjk_tokens(F.col("q"))).alias("tokens"))


@query(
    "detected_labels",
    TOKENS + f", c AS (SELECT query_id, {sql.canonical_list('tokens')} AS canon FROM t) SELECT query_id, array_to_string({sql.ordered_distinct('canon')}, ',') AS labels FROM c",
)
def detected_labels(spark, sf_dir):
    tokens = text.query_tokens(F.col("q"))
    return _log(spark, sf_dir).select("query_id", _joined(text.detected_labels(tokens)).alias("labels"))


@query(
    "query_expansion",
    TOKENS + f", c AS (SELECT query_id, {sql.expanded_list('tokens')} AS every FROM t) SELECT query_id, array_to_string({sql.ordered_distinct('every')}, ',') AS expanded FROM c",
)
def query_expansion(spark, sf_dir):
    tokens = text.query_tokens(F.col("q"))
    return _log(spark, sf_dir).select("query_id", _joined(text.expand_tokens(tokens)).alias("expanded"))


@query(
    "active_labels",
    TOKENS + f", c AS (SELECT query_id, list_concat({sql.words('requested')}, {sql.canonical_list('tokens')}) AS every FROM t) "
    f"SELECT query_id, array_to_string({sql.ordered_distinct('every')}, ',') AS labels FROM c",
)
def active_labels(spark, sf_dir):
    found = text.detected_labels(text.query_tokens(F.col("q")))
    return _log(spark, sf_dir).select("query_id", _joined(text.active_labels(words("requested"), found)).alias("labels"))


# the oracle engine counts edits in bytes; the vocabulary is ASCII, so any other letter may stand as one #
WORDS = LOG + r""", w AS (SELECT query_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM
  (SELECT query_id, list_filter(regexp_split_to_array(q, '\s+'), lambda t: regexp_matches(t, '^\p{L}+$')) AS ws FROM query_log)),
vocab AS (SELECT * FROM (VALUES """ + ", ".join(f"('{w}', {i})" for i, w in enumerate(fixed.SPELL_VOCABULARY)) + """) v(word, place)),
near AS (SELECT token, word, row_number() OVER (PARTITION BY token ORDER BY levenshtein(flat, word), place) AS rn
  FROM (SELECT DISTINCT lower(w) AS token, regexp_replace(lower(w), '[^a-z]', '#', 'g') AS flat FROM w), vocab
  WHERE levenshtein(flat, word) <= 2 AND token NOT IN (SELECT word FROM vocab)),
fix AS (SELECT token, word FROM near WHERE rn = 1)
"""


@query("spell_tokens", WORDS + "SELECT token, word AS suggestion FROM fix")
def spell_tokens(spark, sf_dir):
    """Suggestions are worked out once per distinct word of the whole log."""
    tokens = F.filter(F.split("q", r"\s+"), lambda t: t.rlike(r"^\p{L}+$"))
    distinct = _log(spark, sf_dir).select(F.explode(tokens).alias("token")).select(F.lower("token").alias("token")).distinct()
    return distinct.withColumn("suggestion", text.suggest_word(F.col("token"))).filter(F.col("suggestion").isNotNull())


_EDGE = r"[^\p{L}\p{N}_]"


def _replaced(text_sql: str) -> str:
    return (
        rf"regexp_replace({text_sql}, '(?i)(^|{_EDGE})' || split_part(e, '|', 1) || '($|{_EDGE})', "
        r"'\1' || split_part(e, '|', 2) || '\2', 'g')"
    )


@query(
    "spell_query",
    WORDS + f""", edits AS (SELECT query_id, list(w || '|' || word ORDER BY i) AS es FROM w JOIN fix ON lower(w) = token GROUP BY query_id),
    fixed AS (SELECT l.query_id, q, CASE WHEN es IS NULL THEN NULL ELSE
      list_reduce(es, lambda acc, e: {_replaced(_replaced('acc'))}, q) END AS c
      FROM query_log l LEFT JOIN edits USING (query_id))
    SELECT query_id, CASE WHEN lower(c) <> lower(q) THEN c END AS suggestion FROM fixed""",
)
def spell_query(spark, sf_dir):
    return _log(spark, sf_dir).select("query_id", text.correct_query(F.col("q")).alias("suggestion"))


@query(
    "synonym_forms",
    """WITH j AS (SELECT p_partkey AS seq, p_type AS canonical, [p_type, p_name, p_brand] AS forms FROM part),
    f AS (SELECT seq, canonical, forms, unnest(forms) AS form, generate_subscripts(forms, 1) AS place FROM j)
    SELECT lower(form) AS form, arg_max(canonical, (seq, place)) AS canonical, array_to_string(arg_max(forms, (seq, place)), ',') AS forms
    FROM f GROUP BY 1""",
)
def synonym_forms(spark, sf_dir):
    """Dictionary texts written from the part table: type -> its name and brand, later parts win."""
    entry = F.create_map("p_type", F.array("p_name", "p_brand"))
    texts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("seq"), F.to_json(entry).alias("value"))
    return forms_of(texts).select("form", "canonical", _joined("forms").alias("forms"))


# --- label rules -------------------------------------------------------------

TEXTS = ctes("label_texts") + ", x AS (SELECT *, concat_ws(' ', name, description, cuisine_type) AS body FROM label_texts)"


def _documents(spark, sf_dir):
    rows = view(spark, sf_dir, "label_texts")
    return rows.withColumns({c: words(c) for c in ("diet_labels", "allergens", "allergen_free")})


def _body():
    none = F.array().cast("array<string>")
    return labels.labelling_text(F.col("name"), F.col("description"), F.col("cuisine_type"), none, none)


def _rule_query(name, rules):
    @query(name, TEXTS + f"SELECT restaurant_id, array_to_string({sql.rule_list('body', rules)}, ',') AS labels FROM x")
    def run(spark, sf_dir):
        found = labels.rule_labels(_body(), rules)
        return _documents(spark, sf_dir).select("restaurant_id", _joined(found).alias("labels"))

    return run


_rule_query("label_diet", fixed.DIET_RULES)
_rule_query("label_allergen", fixed.ALLERGEN_RULES)
_rule_query("label_allergen_free", fixed.ALLERGEN_FREE_RULES)


@query(
    "label_text",
    ctes("restaurants", "menu_items") + """, m AS (SELECT restaurant_id, string_agg(name, ' ' ORDER BY name, item_id) AS items FROM menu_items GROUP BY 1)
    SELECT restaurant_id, concat_ws(' ', name, description, cuisine_type, items) AS body FROM restaurants LEFT JOIN m USING (restaurant_id)""",
)
def label_text(spark, sf_dir):
    from workload.catalog import with_menu

    none = F.array().cast("array<string>")
    items = F.transform("menu_items", lambda m: m["name"])
    body = labels.labelling_text(F.col("name"), F.col("description"), F.col("cuisine_type"), none, F.coalesce(items, none))
    return with_menu(spark, sf_dir).select("restaurant_id", body.alias("body"))


def _merged(given, rules):
    return f"list_sort(list_distinct(list_concat({sql.words(given)}, {sql.rule_list('body', rules)})))"


@query(
    "label_catalog",
    TEXTS + f""", l AS (SELECT restaurant_id, {_merged('diet_labels', fixed.DIET_RULES)} AS d, {_merged('allergens', fixed.ALLERGEN_RULES)} AS a,
    {_merged('allergen_free', fixed.ALLERGEN_FREE_RULES)} AS f FROM x)
    SELECT restaurant_id, array_to_string(d, ',') AS diet_labels, array_to_string(a, ',') AS allergens,
    array_to_string(list_filter(f, lambda v: NOT list_contains(a, v)), ',') AS allergen_free FROM l""",
)
def label_catalog(spark, sf_dir):
    done = label_documents(_documents(spark, sf_dir))
    return done.select("restaurant_id", *[_joined(c).alias(c) for c in ("diet_labels", "allergens", "allergen_free")])


@query(
    "label_names",
    ctes("restaurants", "food_log")
    + f""", u AS (SELECT 'diet' AS kind, unnest({sql.words('diet_labels')}) AS code FROM restaurants
    UNION ALL SELECT 'price', CAST(price_level AS VARCHAR) FROM restaurants UNION ALL SELECT 'meal', meal_type FROM food_log),
    names AS (SELECT * FROM (VALUES """
    + ", ".join(
        f"('{k}', {sql.quote(str(c))}, {sql.quote(n)})"
        for k, d in (("diet", fixed.DIET_LABEL_NAMES), ("price", fixed.PRICE_LEVEL_NAMES), ("meal", fixed.MEAL_NAMES))
        for c, n in d.items()
    )
    + """) v(kind, code, label))
    SELECT kind, code, label, count(*) AS n FROM u LEFT JOIN names USING (kind, code) GROUP BY ALL""",
)
def label_names(spark, sf_dir):
    """Display names of the codes in use, with how often each occurs."""
    catalog = view(spark, sf_dir, "restaurants")
    kinds = [
        (catalog.select(F.explode(words("diet_labels")).alias("code")), "diet", fixed.DIET_LABEL_NAMES),
        (catalog.select(F.col("price_level").cast("string").alias("code")), "price", {str(k): v for k, v in fixed.PRICE_LEVEL_NAMES.items()}),
        (view(spark, sf_dir, "food_log").select(F.col("meal_type").alias("code")), "meal", fixed.MEAL_NAMES),
    ]
    parts = [
        codes.groupBy("code").agg(F.count("*").alias("n")).select(
            F.lit(kind).alias("kind"), "code", named(F.col("code"), names).alias("label"), "n"
        )
        for codes, kind, names in kinds
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
