from pyspark.sql import functions as F

from docquarry.functions import json as J
from docquarry.functions import mentions as M
from docquarry.functions import text as T


def one(spark, use, x):
    return spark.createDataFrame([(x,)], "x string").select(use(F.col("x"))).first()[0]


def test_headings_and_symbols(spark):
    assert one(spark, T.clean_headings, "### 4.1.2 Effect\n## 3D printing") == "### Effect\n## D printing"
    assert one(spark, T.normalize_elements, r"$\mathrm{{Cr}}$ $\mathbf{Ti}$") == "Cr Ti"
    assert one(spark, T.normalize_temperatures, r"${850}^{ \circ  }\mathrm{C}$, ${1000}\mathrm{\;h}$, ${10}\mathrm{h}$") == "850 °C, 1000 h, 10 h"
    assert one(spark, T.normalize_units, r"${189.5}\mathrm{\;{nm}}$ $\%$ ${30}\mathrm{\;K}$") == "189.5 nm % 30 K"
    assert one(spark, T.normalize_phases, r"$\gamma /{\gamma }^{\prime }$ γ ’") == "γ / γ′ γ′"
    assert one(spark, T.normalize_citations, r"\left\lbrack {2,{62} - {64}}\right\rbrack") == "[2,62-64]"
    assert one(spark, T.normalize_spacing, "a  ( b ) ,\n c .") == "a (b),\n c."


def test_names(spark):
    assert one(spark, T.source_label, "a\\b/c.md/") == "c.md"
    assert one(spark, T.slug, " !! ") == "node"
    assert one(spark, T.document_id, "_cleaned") == "document"


def test_mentions(spark):
    assert one(spark, M.figures, "Figs. 1, 2 and 3; Fig. 10; Fig. i") == ["Fig. 1", "Fig. 10", "Fig. 2", "Fig. 3"]
    assert one(spark, M.citations, "[2-4, 7] [4-2] [x] [99999999999999999999]") == ["ref_2", "ref_3", "ref_4", "ref_7"]
    assert one(spark, M.equations, "Eq. (3) and [EQUATION:eq_1], Equation 2a") == ["eq_1", "eqnum::3"]
    assert one(spark, M.tables, None) == []


def test_lenient_json(spark):
    assert one(spark, J.first_object, '```json\n{"a":1}\n```') == '{"a":1}'
    assert one(spark, J.first_object, 'so {"a":1} it is') == '{"a":1}'
    assert one(spark, J.first_object, "[1]") is None
    assert J.merged({"a": {"b": 1, "c": 2}}, {"a": {"b": None}}) == {"a": {"b": None, "c": 2}}


def test_citation_ranges_have_no_cap(spark):
    assert len(one(spark, M.citations, "[1-20000]")) == 20_000
    assert one(spark, M.citations, "[1-9999999999] [3]") == ["ref_3"]
    assert [(s["first"], s["last"]) for s in one(spark, M.citation_spans, "[1–9999999999], [7, 5-4]")] == [(1, 9999999999), (7, 7)]


def test_guarded_rules(spark):
    """Texts without the string that a rule needs are passed over; null stays null."""
    assert one(spark, T.normalize_units, "no money") == "no money" and one(spark, T.normalize_phases, None) is None
    assert one(spark, T.strip, "　a\xa0b\n") == "a\xa0b" and one(spark, T.normalize_newlines, "a\r\nb\rc") == "a\nb\nc"


def test_literals_of_rules(spark):
    """Every match of a rule has its literals, and a text that lacks them stays as it is."""
    assert T.literals(r"(?U)\$\{(\d+)\}\\mathrm\{\s*\;?\{nm\}\}\$") == ["${", r"}\mathrm{", "{nm}}$"] and T.literals(r"(?U)γ\s*[’'′]") == ["γ"]
    assert T.literals("(?i)abc") == T.literals("abc|de") == T.literals(r"a{2}b?[cd]+") == [] and T.literals(r"x(a[)]b(c)\))yz") == ["yz"]
    for text in (r"${5\mu }\mathrm{m}$ and ${5}\mathrm{\; {nm}}$", r"${900}^{ \circ }\mathrm{C}/{24}\mathrm{ h }$ $\gamma / \gamma$ γ ’", "$ plain"):
        for rules in (T.UNIT_RULES, T.TEMPERATURE_RULES, T.PHASE_RULES, T.NOTATION_RULES):
            plain = F.lit(text)
            for pattern, new in rules:
                plain = F.regexp_replace(plain, F.lit(pattern), F.lit(new))
            got = spark.range(1).select(T.rewrite(F.lit(text), rules).alias("a"), plain.alias("b")).first()
            assert got.a == got.b
