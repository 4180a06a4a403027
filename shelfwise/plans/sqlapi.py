"""Ad-hoc SQL over the star schema, read-only.

The text is parsed and analysed, which runs nothing, and the analysed plan is
walked against allow lists before it may run:

* plan nodes are those of queries; a command, a script or an external program
  is none;
* relations are the star's views, inline values and the query's own common
  table expressions; a file path or a catalog table is no view;
* functions are Spark's own of harmless groups; calls of Java methods, readers
  of schema files and functions that users registered are in none of them.

Sub-queries are walked like the query itself.  Errors are raised, not
swallowed.
"""

from __future__ import annotations

import weakref

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from ..operators.star import STAR_TABLES, register_star

# The nodes an analysed query may have.
PLAN_NODES = frozenset((
    "Aggregate", "CTERelationDef", "CTERelationRef", "Deduplicate", "Distinct", "Except", "Expand",
    "Filter", "Generate", "GlobalLimit", "Intersect", "Join", "LateralJoin", "LocalLimit",
    "LocalRelation", "Offset", "OneRowRelation", "Pivot", "Project", "Sort", "SubqueryAlias",
    "Union", "UnionLoop", "UnionLoopRef", "Unpivot", "Window", "WithCTE"))
# Groups of built-in functions that only compute.
FUNCTION_GROUPS = frozenset((
    "agg_funcs", "array_funcs", "bitwise_funcs", "collection_funcs", "conditional_funcs",
    "conversion_funcs", "datetime_funcs", "generator_funcs", "hash_funcs", "json_funcs",
    "lambda_funcs", "map_funcs", "math_funcs", "operator_funcs", "predicate_funcs",
    "string_funcs", "struct_funcs", "window_funcs"))
# Expressions that are no functions: columns, literals, casts,
# sub-queries, and the parts of windows, lambdas, grouping and aggregates.
EXPRESSIONS = frozenset((
    "AggregateExpression", "Alias", "AttributeReference", "Cast", "CurrentRow$", "EqualNullSafe",
    "Exists", "GetArrayItem", "GetArrayStructFields", "GetMapValue", "GetStructField",
    "GroupingID", "If", "InSubquery", "LambdaFunction", "LateralSubquery", "ListQuery", "Literal",
    "NamedLambdaVariable", "OuterReference", "PivotFirst", "RangeFrame$", "RowFrame$", "ScalarSubquery",
    "SortOrder", "SpecialFrameBoundary", "SpecifiedWindowFrame", "UnaryMinus",
    "UnboundedFollowing$", "UnboundedPreceding$", "UnspecifiedFrame$", "UpCast",
    "VirtualColumn", "WindowExpression", "WindowSpecDefinition"))
# What builders make under another name than their own.
BUILT = frozenset(("CurrentDate", "Extract", "Mode", "RoundCeil", "RoundFloor", "StringLPad",
                   "StringRPad", "TimestampAdd", "TimestampDiff", "TryEval"))
_EXPRESSION_PACKAGES = ("org.apache.spark.sql.catalyst.expressions.",)
_COMMAND = "org.apache.spark.sql.catalyst.plans.logical.Command"
_REPLACED = "org.apache.spark.sql.catalyst.expressions.InheritAnalysisRules"


class NotAQuery(ValueError):
    """The text is not a single read-only query over the allowed tables."""


def _items(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _name(node) -> str:
    return node.getClass().getName()


_groups: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def _built_in(spark: SparkSession) -> dict[str, set]:
    """Groups of each class that implements a built-in function."""
    if spark not in _groups:
        registry = spark._jvm.org.apache.spark.sql.catalyst.analysis.FunctionRegistry.expressions()
        out: dict[str, set] = {}
        for pair in _items(registry.values().toSeq()):
            info = pair._1()
            # some are registered by the class that builds their expression
            name = info.getClassName().removesuffix("Builder").removesuffix("Expression")
            out.setdefault(name, set()).add(info.getGroup())
        _groups[spark] = out
    return _groups[spark]


class _Walk:
    """One pass over an analysed plan; raises at the first thing that is not
    allowed."""

    def __init__(self, spark: SparkSession, tables: frozenset):
        self.tables, self.groups = tables, _built_in(spark)
        self.replaced = spark._jvm.java.lang.Class.forName(_REPLACED)

    def plan(self, node) -> None:
        kind = _name(node).rpartition(".")[2]
        if kind == "View":
            view = node.desc().identifier()
            if not node.isTempView() or view.table().lower() not in self.tables:
                raise NotAQuery(f"not one of the star's tables: {view.unquotedString()}")
            return              # what the view reads is the star's own
        if kind not in PLAN_NODES:
            raise NotAQuery(f"not allowed in a read-only query: {node.nodeName()}")
        for child in _items(node.children()) + [
                x for x in _items(node.innerChildren()) if hasattr(x, "nodeName")]:
            self.plan(child)
        for e in _items(node.expressions()):
            self.expression(e)

    def expression(self, e) -> None:
        name = _name(e)
        full = name.rpartition(".")[2]
        groups = self.groups.get(name)
        if groups is not None and name.startswith(_EXPRESSION_PACKAGES):
            ok = groups <= FUNCTION_GROUPS
        else:
            ok = name.startswith(_EXPRESSION_PACKAGES) and full in EXPRESSIONS | BUILT
        if not ok:
            raise NotAQuery(f"not allowed in a read-only query: {e.prettyName()}")
        if full in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery"):
            self.plan(e.plan())
        # a function that stands for another expression: what the query gave it
        parts = e.parameters() if self.replaced.isInstance(e) else e.children()
        for x in _items(parts):
            self.expression(x)


def check_query(spark: SparkSession, sql: str, tables=None) -> str:
    """Return the cleaned text if it is one read-only query over ``tables``
    (names of temporary views; None: all of the session's), else raise."""
    text = sql.strip()
    while text.endswith(";"):
        text = text[:-1].rstrip()
    if tables is None:
        tables = [t.name for t in spark.catalog.listTables() if t.isTemporary]
    try:
        parsed = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
        if spark._jvm.java.lang.Class.forName(_COMMAND).isInstance(parsed):
            raise NotAQuery("not a read-only query: a command")
        # as a sub-query nothing but a query can be analysed, and nothing runs
        analysed = spark.sql(f"SELECT * FROM (\n{text}\n) q")._jdf.queryExecution().analyzed()
    except NotAQuery:
        raise
    except Exception as e:  # parse or analysis error of the text
        reason = e.getMessage() if isinstance(e, PySparkException) else e
        raise NotAQuery(f"not a read-only query: {reason}") from e
    _Walk(spark, frozenset(t.lower() for t in tables)).plan(analysed)
    return text


def run_sql(spark: SparkSession, sql: str, star: dict | None = None) -> DataFrame:
    """Check then run ``sql``; with ``star`` its tables are registered first,
    and only they may be read."""
    if star is not None:
        register_star(star)
    tables = None if star is None else [t for t in STAR_TABLES if t in star]
    return spark.sql(check_query(spark, sql, tables))
