"""Queries on parameters in JSON documents, limits, and rules that other queries don't reach."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import units
from ..operators import incremental as inc
from ..operators import judges, parameters, recovery, reports, rows, runnability
from . import register
from .judgments import rounded
from .views import ATTEMPT, JUDGMENT, RUN, attempt, judgment, read, run

# Documents made of a part's columns: four numbers, text with and without one, a list, a truth value, and names that are no physics.
_DOC = """to_json(named_struct('parameters', named_struct('mass', named_struct('value', p_size, 'unit', 'kg'), 'speed', concat(p_size, '.5 m/s'), 'note', p_mfgr_text,
 'sides', array(p_size), 'flag', true, 'ball_color', p_size, 'camera', p_size, 'drag', p_size / 4D, 'empty', CAST(NULL AS INT))))"""
_GOOD = "p_size <> 7"


def _documents(spark, d):
    part = read(spark, d, "part").withColumn("p_mfgr_text", F.lit("none"))
    return part.select("p_partkey", F.expr(f"CASE WHEN {_GOOD} THEN {_DOC} ELSE 'not json' END").alias("document"), F.expr("p_size % 5 <> 0").alias("parse_ok"))


_NUMBERS = "('mass', p_size::DOUBLE, 'kg'), ('speed', p_size + 0.5::DOUBLE, ''), ('drag', p_size / 4.0::DOUBLE, '')"


@register("gt_parameters", f"SELECT p_partkey, v.name, v.value, v.unit FROM part, LATERAL (VALUES {_NUMBERS}) v(name, value, unit) WHERE {_GOOD}")
def gt_parameters(spark, d):
    return parameters.numeric_parameters(_documents(spark, d), "document", True).select("p_partkey", "name", "value", "unit")


@register("predicted_parameters", f"""SELECT p_partkey, v.name, v.value, v.unit FROM part, LATERAL (VALUES {_NUMBERS}, ('ball_color', p_size::DOUBLE, ''), ('camera', p_size::DOUBLE, '')) v(name, value, unit)
WHERE {_GOOD} AND p_size % 5 <> 0""")
def predicted_parameters(spark, d):
    return parameters.numeric_parameters(_documents(spark, d), "document", False, F.col("parse_ok")).select("p_partkey", "name", "value", "unit")


@register("skipped_parameters", f"SELECT p_partkey, 'note,sides,flag,ball_color,camera' AS skipped FROM part WHERE {_GOOD}")
def skipped_parameters(spark, d):
    docs = _documents(spark, d)
    kept = parameters.numeric_parameters(docs, "document", True)
    listed = parameters.left_out(docs, kept, ["p_partkey"], "document")
    return listed.select("p_partkey", F.array_join("skipped", ",").alias("skipped"))


@register("limit_zero_is_all", f"WITH {ATTEMPT} SELECT sample, model FROM attempt")
def limit_zero_is_all(spark, d):
    return parameters.first_of_each(attempt(spark, d), ["model"], ["sample"], 0, True).select("sample", "model")


@register("first_per_model", f"WITH {ATTEMPT} SELECT sample, model FROM (SELECT sample, model, row_number() OVER (PARTITION BY model ORDER BY sample) AS i FROM attempt) WHERE i <= 3")
def first_per_model(spark, d):
    return parameters.first_of_each(attempt(spark, d), ["model"], ["sample"], 3, True).select("sample", "model")


@register("first_pending", f"WITH {ATTEMPT} SELECT sample FROM attempt WHERE sample NOT IN (SELECT l_orderkey FROM lineitem WHERE l_shipdate > DATE '1997-01-01') ORDER BY sample LIMIT 25")
def first_pending(spark, d):
    done = read(spark, d, "lineitem").where("l_shipdate > DATE'1997-01-01'").select(F.col("l_orderkey").alias("sample"))
    pending = inc.null_safe_anti(attempt(spark, d).select("sample"), done, ["sample"])
    return parameters.first_of_each(pending, [], ["sample"], 25, False)


@register("failed_originals", f"WITH {ATTEMPT}, failed AS (SELECT DISTINCT customer FROM attempt WHERE NOT parse_ok) SELECT customer, max(sample) AS sample FROM attempt WHERE customer IN (SELECT customer FROM failed) GROUP BY customer")
def failed_originals(spark, d):
    a = attempt(spark, d)
    return parameters.originals_of(a.where("NOT parse_ok"), a, ["customer"], ["sample"]).select("customer", "sample")


@register("last_recovered_wins", f"""WITH {ATTEMPT}, rec AS (SELECT o_custkey AS customer, arg_max(o_totalprice > 200000, o_orderkey) AS new FROM orders GROUP BY ALL)
SELECT sample, coalesce(new, parse_ok) AS parse_ok FROM attempt LEFT JOIN rec USING (customer)""")
def last_recovered_wins(spark, d):
    rec = read(spark, d, "orders").selectExpr("o_custkey AS customer", "o_orderkey", "o_totalprice > 200000D AS parse_ok")
    return inc.overridden(attempt(spark, d).select("sample", "customer", "parse_ok"), rec, ["customer"], "parse_ok", ["o_orderkey"]).select("sample", "parse_ok")


_FIVE = {"codebleu": "l_discount", "ngram": "l_tax", "weighted": "l_extendedprice", "syntax": "l_quantity", "dataflow": "l_linenumber"}


@register("codebleu_fields", " UNION ALL ".join(f"SELECT l_returnflag AS model, '{f}' AS field, round(avg({c}), 6) AS mean, round(median({c}), 6) AS median, round(min({c}), 6)::DOUBLE AS low, round(max({c}), 6)::DOUBLE AS high, count({c}) AS n FROM lineitem GROUP BY l_returnflag" for f, c in _FIVE.items()))
def codebleu_fields(spark, d):
    wide = read(spark, d, "lineitem").select(F.col("l_returnflag").alias("model"), *(F.col(c).cast("double").alias(f) for f, c in _FIVE.items()))
    long = wide.unpivot(["model"], list(_FIVE), "field", "v")
    return rounded(reports.distribution(long, ["model", "field"], "v"), "mean", "median", "low", "high")


@register("error_matrix", f"WITH {JUDGMENT} SELECT scorer, judge, count(*) AS n FROM judgment WHERE errored GROUP BY ALL")
def error_matrix(spark, d):
    return reports.matrix(judgment(spark, d).where("errored"), "scorer", "judge")


@register("top_error_messages", f"WITH {RUN} SELECT reason, count(*) AS n FROM run WHERE NOT runs_ok GROUP BY ALL ORDER BY n DESC, reason LIMIT 10")
def top_error_messages(spark, d):
    return rows.most_common(run(spark, d).where("NOT runs_ok"), "reason", 10)


@register("judge_gate", f"""WITH {ATTEMPT} SELECT sample, j.judge AS judge_model, 'parse_ok_cot=False' AS skip_reason FROM attempt, (VALUES ('j0'), ('j1')) j(judge) WHERE NOT parse_ok""")
def judge_gate(spark, d):
    return inc.gate(attempt(spark, d), "parse_ok", "parse_ok_cot=False", ["j0", "j1"])[1].select("sample", "judge_model", "skip_reason")


@register("code_gate", f"WITH {ATTEMPT} SELECT sample, CASE WHEN NOT code_ok THEN 'parse_ok_code=False' WHEN experiment = '5-LOW' THEN 'empty_parsed_code' END AS reason FROM attempt")
def code_gate(spark, d):
    a = attempt(spark, d).withColumn("code", F.when(F.col("experiment") == "5-LOW", " ").otherwise("x = 1"))
    return a.select("sample", inc.code_gate("code", "code_ok").alias("reason"))


@register("scored_variants", f"""WITH {JUDGMENT}, s AS (SELECT scorer, skipped, errored, score > 0 AS there FROM judgment)
SELECT scorer, count(*) FILTER (NOT skipped AND NOT errored AND there) AS strict, count(*) FILTER (NOT skipped) AS not_skipped, count(*) FILTER (NOT skipped AND there) AS with_scores FROM s GROUP BY scorer""")
def scored_variants(spark, d):
    j = judgment(spark, d).withColumn("value", F.when(F.col("score") > 0, F.col("score")))
    rules = {"strict": rows.scored("skipped", "errored", "value"), "not_skipped": rows.scored("skipped", "errored", None, True), "with_scores": rows.scored("skipped", "errored", "value", True)}
    return j.groupBy("scorer").agg(*(F.count_if(r).alias(n) for n, r in rules.items()))


@register("law_fields", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN '' ELSE p_name END AS name, CASE WHEN p_size % 3 = 1 THEN CAST(p_size AS VARCHAR) ELSE '' END AS statement, '' AS formula FROM part")
def law_fields(spark, d):
    document = F.expr("""CASE p_size % 3 WHEN 0 THEN '{"physical_law": [1]}' WHEN 1 THEN to_json(named_struct('physical_law', named_struct('name', p_name, 'statement', p_size)))
     ELSE to_json(named_struct('physical_law', named_struct('name', p_name))) END""")
    return read(spark, d, "part").select("p_partkey", inc.law(document).alias("l")).select("p_partkey", "l.*")


@register("filled_prompts", "SELECT p_partkey, concat('Law: ', CASE WHEN p_size % 2 = 0 THEN '(empty)' ELSE p_name END, '; size ', p_size, '.') AS prompt FROM part")
def filled_prompts(spark, d):
    values = {"law": F.when(F.col("p_size") % 2 == 0, "").otherwise(F.col("p_name")), "size": F.col("p_size").cast("string")}
    return read(spark, d, "part").select("p_partkey", inc.filled("Law: {law}; size {size}.", values).alias("prompt"))


@register("base_records", f"WITH {ATTEMPT} SELECT sample, 'law' AS scorer, 'j0' AS judge_model, FALSE AS skipped, NULL AS judge_error FROM attempt")
def base_records(spark, d):
    keyed = attempt(spark, d).withColumn("sample_id", F.col("sample").cast("string"))
    out = inc.base_record(keyed, "law", "j0")
    return out.select(F.col("sample_id").cast("long").alias("sample"), "scorer", "judge_model", "skipped", "judge_error")


#: Fixed values, written out from the format's rules: unit, canonical unit, and what one of it is.
_EXPECTED = """('deg', 'rad', pi() / 180), ('degree', 'rad', pi() / 180), ('degrees', 'rad', pi() / 180), ('°', 'rad', pi() / 180),
('rad', 'rad', 1), ('radian', 'rad', 1), ('radians', 'rad', 1),
('mm', 'm', 0.001), ('millimeter', 'm', 0.001), ('millimetre', 'm', 0.001), ('cm', 'm', 0.01), ('centimeter', 'm', 0.01), ('centimetre', 'm', 0.01),
('km', 'm', 1000), ('m', 'm', 1), ('meter', 'm', 1), ('metre', 'm', 1),
('g', 'kg', 0.001), ('gram', 'kg', 0.001), ('grams', 'kg', 0.001), ('kg', 'kg', 1), ('kilogram', 'kg', 1),
('ms', 's', 0.001), ('millisecond', 's', 0.001), ('s', 's', 1), ('sec', 's', 1), ('second', 's', 1), ('seconds', 's', 1),
('m/s', 'm/s', 1), ('ms-1', 'm/s', 1), ('ms^{-1}', 'ms{-1}', 1), ('km/h', 'm/s', 1 / 3.6), ('kph', 'm/s', 1 / 3.6),
('kn', 'n', 1000), ('n', 'n', 1), ('newton', 'n', 1), ('kpa', 'pa', 1000), ('mpa', 'pa', 1000000), ('furlong', 'furlong', 1)"""


@register("unit_spellings", f"WITH u(unit, canonical, factor) AS (VALUES {_EXPECTED}) SELECT p_partkey, unit, canonical, round(p_size * factor::DOUBLE, 9) AS value FROM part, u")
def unit_spellings(spark, d):
    spelled = [row.split("'")[1] for row in _EXPECTED.split("(") if row.count("'") >= 4]
    each = read(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("v"), F.explode(F.array(*map(F.lit, spelled))).alias("unit"))
    return each.select("p_partkey", "unit", units.canonical_unit(F.col("unit")).alias("canonical"), F.round(units.canonical_value(F.col("v"), F.col("unit")), 9).alias("value"))


@register("recovered_documents", """SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN 'no_cot_block' WHEN doc_id % 4 = 2 THEN 'json5'
  WHEN doc_id % 4 = 1 AND NOT coalesce(contains(text, '//') OR contains(text, '/*'), FALSE) THEN 'basic_fixups' ELSE 'raw' END AS method FROM documents""")
def recovered_documents(spark, d):
    """Every whole text as the statement of a law: sound JSON, with a comma too many, in
    the looser grammar (a key without quotes), and none. What looks like a comment
    in a text would be cut out with the comma, so such a text is sound here."""
    quoted = F.to_json(F.struct(F.struct(F.lit("N").alias("name"), F.col("text").alias("statement")).alias("physical_law")))
    comment = F.coalesce(F.contains("text", F.lit("//")) | F.contains("text", F.lit("/*")), F.lit(False))
    kind = F.col("doc_id") % 4
    loose = F.concat(F.lit("{'physical_law': {name: 'N', n: +.5, "), F.lit("statement: "), F.to_json(F.array(F.coalesce("text", F.lit("")))), F.lit("}}"))
    written = F.when((kind == 1) & ~comment, F.regexp_replace(quoted, r"\}$", ",}")).when(kind == 2, loose).otherwise(quoted)
    raw = F.when(kind == 3, "prose").otherwise(F.concat(F.lit("@@COT_BEGIN@@ "), written, F.lit(" @@COT_END@@")))
    docs = read(spark, d, "documents").select("doc_id", raw.alias("raw_output"), F.lit(False).alias("parse_ok_cot"))
    return recovery.recovered(docs).select("doc_id", F.col("cot_recovery_method").alias("method"))


@register("syntax_errors", """SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN NULL WHEN 1 THEN 'SyntaxError: expected ''('' (line 1)' ELSE 'SyntaxError: ''('' was never closed (line 1)' END AS error FROM part""")
def syntax_errors(spark, d):
    code = F.expr("CASE p_size % 3 WHEN 0 THEN concat('x = ', p_size) WHEN 1 THEN 'def f' ELSE concat('y = (', p_size) END")
    return read(spark, d, "part").select("p_partkey", runnability.syntax_errors(code).alias("error"))


_NAME = "CASE p_partkey % 5 WHEN 0 THEN concat(n, '_3d_', n) WHEN 1 THEN concat('u_tube_', n, '_U_TUBE') WHEN 2 THEN concat(n, '_vs_2D_vsx') WHEN 3 THEN concat('2d', '_x3d ', n) ELSE n END"


@register("display_names", rf"""WITH s AS (SELECT p_partkey, {_NAME} AS s FROM (SELECT p_partkey, replace(p_name, ' ', '_') AS n FROM part)),
r AS (SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(replace(s, '_', ' '), '\b(\d)[dD]\b', '\1D', 'g'), '\bvs\b', 'vs.', 'g'), '\bu tube\b', 'U-tube', 'i') AS s FROM s)
SELECT p_partkey, upper(r.s[1:1]) || r.s[2:] AS shown, replace(s.s, '_', '\_') AS latex FROM r JOIN s USING (p_partkey)""")
def display_names(spark, d):
    named = read(spark, d, "part").select("p_partkey", F.replace("p_name", F.lit(" "), F.lit("_")).alias("n")).select("p_partkey", F.expr(_NAME).alias("s"))
    return named.select("p_partkey", parameters.display_name(F.col("s")).alias("shown"), parameters.latex_name(F.col("s")).alias("latex"))


_AMOUNT = "CASE p_partkey % 5 WHEN 0 THEN CAST(p_size AS DOUBLE) WHEN 1 THEN p_retailprice WHEN 2 THEN -(p_retailprice * 1000 + 0.3125) WHEN 3 THEN p_retailprice / 10000000 ELSE p_retailprice / 1000 END"


@register("significant_digits", rf"""WITH v AS (SELECT p_partkey, ({_AMOUNT})::DOUBLE AS v FROM part), a AS (SELECT *, abs(v) AS a FROM v)
SELECT p_partkey, CASE WHEN v = floor(v) THEN printf('%.0f', v)
  WHEN a >= 1e5 OR a < 1e-3 THEN regexp_replace(printf('%.3e', v), 'e([+-])0*(\d)', 'e\1\2')
  ELSE regexp_replace(CASE WHEN a >= 1000 THEN printf('%.0f', v + CASE WHEN a - floor(a) = 0.5 THEN 0.1 ELSE 0 END) WHEN a >= 100 THEN printf('%.1f', v + CASE WHEN a - floor(a) IN (0.25, 0.75) THEN 0.01 ELSE 0 END)
    WHEN a >= 1 THEN printf('%.3f', v) ELSE printf('%.4f', v) END, '(\..*?)\.?0+$|\.0+$', '\1') END AS shown FROM a""")
def significant_digits(spark, d):
    return read(spark, d, "part").select("p_partkey", parameters.number_shown(F.expr(_AMOUNT)).alias("shown"))


@register("looks_math", r"""WITH s AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'law_LaTeX' WHEN 1 THEN 'formula' ELSE 'name' END AS key,
  CASE p_size % 8 WHEN 0 THEN concat('F = m \cdot a^', p_size) WHEN 1 THEN concat('theta_eq = x^', p_size) WHEN 2 THEN '\frac{force}{m} sin(x)' WHEN 3 THEN concat(p_name, '^2') WHEN 4 THEN 'v_{max} = v_0'
    WHEN 5 THEN 'E = mc' WHEN 6 THEN 'x^2 sinus' ELSE '\theta_eq + sqrt x1abc' END AS s FROM part),
b AS (SELECT *, regexp_replace(regexp_replace(s, '\\[a-zA-Z]+', ' ', 'g'), '\{[^{}]*\}', ' ', 'g') AS bare FROM s)
SELECT p_partkey, regexp_matches(key, '(?i)latex|formula') AND regexp_matches(s, '\\[a-zA-Z]+|\^|_\{') AND NOT regexp_matches(s, '(^|[^\\a-zA-Z])[a-zA-Z]+_[a-zA-Z]{2,}')
  AND len(list_filter(regexp_extract_all(bare, '\b[a-zA-Z]{3,}\b'), lambda w: w NOT IN ('sin', 'cos', 'tan', 'exp', 'log', 'max', 'min', 'sgn', 'sign', 'atan', 'tanh', 'sinh', 'cosh', 'sqrt'))) = 0 AS math FROM b""")
def looks_math(spark, d):
    text = F.expr(r"""CASE p_size % 8 WHEN 0 THEN concat(r'F = m \cdot a^', p_size) WHEN 1 THEN concat('theta_eq = x^', p_size) WHEN 2 THEN r'\frac{force}{m} sin(x)' WHEN 3 THEN concat(p_name, '^2') WHEN 4 THEN 'v_{max} = v_0'
        WHEN 5 THEN 'E = mc' WHEN 6 THEN 'x^2 sinus' ELSE r'\theta_eq + sqrt x1abc' END""")
    key = F.expr("CASE p_partkey % 3 WHEN 0 THEN 'law_LaTeX' WHEN 1 THEN 'formula' ELSE 'name' END")
    return read(spark, d, "part").select("p_partkey", parameters.looks_math(text, key).alias("math"))


@register("ranked_page", "SELECT p_partkey, p_retailprice, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS rank, round(p_retailprice / (SELECT max(p_retailprice) FROM part), 6) AS bar FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 24 OFFSET 24")
def ranked_page(spark, d):
    page = parameters.sorted_page(read(spark, d, "part").select("p_partkey", "p_retailprice"), "p_retailprice", True, "p_partkey", number=1)
    return rounded(page, "bar")


@register("ranked_rows", "SELECT p_partkey, p_name, row_number() OVER (ORDER BY p_name DESC, p_partkey) AS rank FROM part")
def ranked_rows(spark, d):
    """Every row's rank by a text column, over ranges of it."""
    ranked = parameters.sorted_page(read(spark, d, "part").select("p_partkey", "p_name"), "p_name", True, "p_partkey", page=None)
    return ranked.select("p_partkey", "p_name", "rank")


#: Failed outputs: texts of the documents that a label calls bad, with made-up messages.
_MESSAGE = "CASE WHEN doc_id % 5 = 0 THEN 'no output: timeout' WHEN doc_id % 7 = 0 THEN '' WHEN doc_id % 7 = 1 THEN NULL ELSE concat('bad ', doc_id % 11) END"


@register("failure_analysis", rf"""WITH f AS (SELECT d.lang AS engine, d.source AS experiment, d.text AS raw_output, {_MESSAGE} AS parse_error, doc_id % 3 = 0 AS code FROM documents d WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0)),
r AS (SELECT *, coalesce(parse_error, '') AS m FROM f),
t AS (SELECT *, starts_with(m, 'no output') AS api, m <> '' AND NOT starts_with(m, 'no output') AS was_cut FROM r),
u AS (SELECT *, CASE WHEN was_cut THEN length(coalesce(raw_output, '')) END AS len, substr(replace(right(raw_output, 80), chr(10), '\n'), 1, 60) AS ending FROM t),
s AS (SELECT 'all' AS section, NULL AS value, * FROM u UNION ALL SELECT 'engine', engine, * FROM u UNION ALL SELECT 'experiment', experiment, * FROM u
  UNION ALL SELECT 'ending', ending, * FROM u WHERE was_cut UNION ALL SELECT 'message', CASE WHEN m = '' THEN '(none)' ELSE m END, * FROM u),
g AS (SELECT section, value, count(*) AS n, count(*) FILTER (api) AS api_errors, count(*) FILTER (was_cut) AS cut, count(*) FILTER (code) AS code_ok, min(len) AS low, median(len) AS median, round(avg(len), 6) AS mean, max(len) AS high
  FROM s GROUP BY section, value)
SELECT *, row_number() OVER (PARTITION BY section ORDER BY n DESC, value) AS rank FROM g QUALIFY rank <= CASE section WHEN 'experiment' THEN 10 WHEN 'ending' THEN 5 WHEN 'message' THEN 5 ELSE 1000000 END""")
def failure_analysis(spark, d):
    bad = read(spark, d, "labels").where("quality = 0").select("doc_id")
    outputs = read(spark, d, "documents").selectExpr("doc_id", "lang AS engine", "source AS experiment", "text AS raw_output", f"{_MESSAGE} AS parse_error", "doc_id % 3 = 0 AS parse_ok_code")
    return rounded(reports.failure_analysis(outputs, only=bad, keys=("doc_id",)), "mean")


@register("worth_retry", f"WITH {RUN} SELECT sample, reason = 'error' AS again FROM run")
def worth_retry(spark, d):
    message = F.when(F.col("reason") == "error", "HTTP 503 Service UNAVAILABLE").otherwise("bad request")
    return run(spark, d).select("sample", judges.worth_retry(message).alias("again"))
