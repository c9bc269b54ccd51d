"""What a condition text may say, decided on the tree that Spark's own parser makes of it.

A condition may use the operators and functions listed here, which answer NULL and never raise, whatever a
line holds. Everything else is refused by name. The text is changed only at places the tree points to:

* A pattern must be a constant; one that cannot be compiled becomes NULL, so the rule is undecided where it
  needs that pattern and still decided where it does not. A LIKE pattern may also come from the record; where it
  is malformed, the rule is undecided on that record.
* ``Log.Level``, ``Log.Service`` and ``Log.Timestamp`` may be absent. In a test of equality with constants
  (``=``, ``<>``, ``IN``, ``NOT IN``) an absent field is merely unequal to all of them. In every other use it is
  NULL, which leaves the rule undecided unless the rest of the condition decides it.
* Calls go to the form of the function that takes what they are called on (text, list, map, struct), and
  ``in_cidr`` with a constant network becomes a test on the bits of the address, which are made once per record.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from logjury.functions.predicates import (
    DEFINITIONS,
    MAP_RECEIVERS,
    PATTERN_ARGUMENTS,
    WIDE_RECEIVERS,
    java_pattern_problem,
)

# Fields that a record may lack, and the text that stands for them in tests of equality. No log line holds it.
ABSENT_FIELDS = frozenset({"log.level", "log.service", "log.timestamp"})
ABSENT = "'\\u0000absent\\u0000'"

# Operators that answer NULL at worst (arithmetic and casts are analysed with ANSI errors off).
OPERATORS = frozenset(
    "And Or Not EqualTo EqualNullSafe LessThan LessThanOrEqual GreaterThan GreaterThanOrEqual In Like ILike LikeAny "
    "LikeAll NotLikeAny NotLikeAll IsNull IsNotNull IsTrue IsFalse IsUnknown CaseWhen Cast Concat Add Subtract Multiply "
    "Divide IntegralDivide Remainder UnaryMinus UnaryPositive Literal UnresolvedAttribute UnresolvedExtractValue "
    "UnresolvedFunction LambdaFunction UnresolvedNamedLambdaVariable CreateNamedStruct BitwiseAnd BitwiseOr BitwiseXor "
    "BitwiseNot Substring StringTrim StringTrimLeft StringTrimRight StringLocate Coalesce".split()
)
# Functions of Spark that answer NULL at worst, whatever texts they are given.
BUILT_IN = frozenset(
    "contains startswith endswith lower upper lcase ucase trim ltrim rtrim btrim length char_length character_length len "
    "octet_length bit_length substr substring substring_index left right coalesce nullif ifnull nvl nvl2 nullifzero zeroifnull if "
    "concat concat_ws locate position instr charindex replace translate reverse initcap ascii overlay between isnull isnotnull "
    "size cardinality array array_size array_contains array_position array_distinct array_max array_min array_sort sort_array "
    "array_compact array_union array_intersect array_except arrays_overlap array_join array_remove slice get map_keys "
    "map_values map_entries map_contains_key map_filter transform_values exists any_match forall filter transform aggregate reduce "
    "try_element_at try_add try_subtract try_multiply try_divide try_mod try_to_binary try_url_decode try_parse_json "
    "try_variant_get get_json_object json_array_length abs sign floor ceil ceiling round greatest least isnan nanvl mod "
    "md5 sha sha1 sha2 crc32 hash xxhash64 hex soundex levenshtein luhn_check bit_count "
    "year month day dayofmonth hour minute second dayofweek weekday quarter current_date current_timestamp now "
    "unix_seconds unix_millis unix_micros named_struct struct boolean string int bigint double float is_valid_utf8".split()
)
OWN = frozenset(DEFINITIONS) | {"contains_any", "matches_any"}
SAFE_FORMS = {
    "element_at": "try_element_at",
    "url_decode": "try_url_decode",
    "parse_json": "try_parse_json",
    "to_binary": "try_to_binary",
    "regexp_like": "matches",
    "rlike": "matches",
    "regexp": "matches",
}
LIKES = {"Like": 1, "ILike": 1}


class ConditionError(ValueError):
    """A condition that must not be used, with the reason."""


@dataclass(eq=False)
class Node:
    """A node of the parsed tree: what it is, its children, and where its text stands.

    Kinds and names come with one call for the whole tree; places are asked for where they are needed.
    """

    kind: str
    name: str = ""  # of a function or field, in lower case
    children: list[Node] = field(default_factory=list)
    parent: Node | None = None
    index: int = 0
    root: object = None  # the parser's own node, at the root

    @cached_property
    def tree(self):
        return self.root if self.parent is None else self.parent.tree.children().apply(self.index)

    @cached_property
    def start(self) -> int:
        found = self.tree.origin().startIndex()
        return found.get() if found.isDefined() else 0

    @cached_property
    def stop(self) -> int:
        """The place behind the last sign."""
        found = self.tree.origin().stopIndex()
        return found.get() + 1 if found.isDefined() else 0

    def walk(self) -> Iterator[Node]:
        """All nodes, children before parents."""
        for child in self.children:
            yield from child.walk()
        yield self

    def is_constant(self) -> bool:
        return not any(n.kind in ("UnresolvedAttribute", "UnresolvedNamedLambdaVariable") for n in self.walk())


def parse(spark: SparkSession, text: str) -> Node:
    """The tree Spark's parser makes of an expression; places count from 0."""
    try:
        tree = spark._jsparkSession.sessionState().sqlParser().parseExpression(text)
    except PySparkException as error:
        raise ConditionError(f"cannot be analysed: {str(error).strip().splitlines()[0]}") from error
    return _node(iter(json.loads(tree.toJSON())), None, 0, tree)


def _node(listed: Iterator[dict], parent: Node | None, index: int, root: object = None) -> Node:
    """The next node of a list in which every node stands before its children."""
    facts = next(listed)
    name = ".".join(str(facts.get("nameParts", "")).strip("[]").split(", ")).lower()
    made = Node(facts["class"].rsplit(".", 1)[-1], name, parent=parent, index=index, root=root)
    made.children = [_node(listed, made, k) for k in range(facts["num-children"])]
    return made


class Editor:
    """Replacements in a text, at places of its tree. A replacement takes in those made inside of it before."""

    def __init__(self, text: str):
        self.text = text
        self.edits: list[tuple[int, int, str]] = []

    def now(self, start: int, stop: int) -> str:
        """The text between two places with the replacements made so far."""
        parts, at = [], start
        for first, last, new in sorted(e for e in self.edits if start <= e[0] and e[1] <= stop):
            parts += [self.text[at:first], new]
            at = last
        return "".join([*parts, self.text[at:stop]])

    def of(self, node: Node) -> str:
        return self.now(node.start, node.stop)

    def put(self, start: int, stop: int, new: str) -> None:
        self.edits = [e for e in self.edits if not (start <= e[0] and e[1] <= stop)]
        self.edits.append((start, stop, new))

    def result(self) -> str:
        return self.now(0, len(self.text))


def check(tree: Node, own: frozenset[str] = frozenset()) -> None:
    """Refuse what is not listed; ``own`` names functions of the caller that never raise."""
    for node in tree.walk():
        if node.kind == "UnresolvedFunction" and node.name not in BUILT_IN | OWN | own:
            hint = f"; use {SAFE_FORMS[node.name]}" if node.name in SAFE_FORMS else ""
            raise ConditionError(f"is refused: {node.name} may not be used in a condition{hint}")
        if node.kind not in OPERATORS:
            hint = "; use matches" if node.kind == "RLike" else ""
            raise ConditionError(f"is refused: {node.kind} may not be used in a condition{hint}")


def compiled(
    spark: SparkSession, sample: DataFrame, text: str, addresses: dict[str, str], own: frozenset[str] = frozenset()
) -> str:
    """The condition as it is evaluated.

    ``sample`` is a record with its roots, by which types are told. ``addresses`` collects the address
    expressions with the columns that are to hold their bits.
    """
    tree = parse(spark, text)
    check(tree, own)
    editor = Editor(text)
    within: set[int] = set()  # inside lambda functions names may be variables
    for node in tree.walk():
        if node.kind == "LambdaFunction":
            within |= {id(n) for n in node.walk()}
    for node in tree.walk():
        if node.kind in ("EqualTo", "In"):
            _absent(node, editor)
        elif node.kind in LIKES:
            _like(spark, node, editor)
        elif node.kind in ("LikeAny", "LikeAll", "NotLikeAny", "NotLikeAll"):
            if _fails(spark, f"'' {editor.of(node)}"):
                raise ConditionError(f"is refused: the patterns of {editor.of(node)} must be constants that can be read")
        elif node.kind == "UnresolvedFunction":
            _patterns(spark, node, editor)
            if node.name in MAP_RECEIVERS and id(node) not in within:
                _receiver(sample, node, editor)
            elif node.name == "in_cidr" and id(node) not in within:
                _network(spark, sample, node, editor, addresses)
    return editor.result()


def _absent(node: Node, editor: Editor) -> None:
    """An absent field in a test of equality with constants."""
    fields = [c for c in node.children if c.kind == "UnresolvedAttribute" and c.name in ABSENT_FIELDS]
    others = [c for c in node.children if c not in fields]
    if len(fields) == 1 and all(c.is_constant() for c in others) and (node.kind == "EqualTo" or fields[0] is node.children[0]):
        editor.put(fields[0].start, fields[0].stop, f"coalesce({editor.of(fields[0])}, {ABSENT})")


def _fails(spark: SparkSession, text: str) -> bool:
    try:
        spark.sql("SELECT 1 AS one").select(F.expr(text)).first()
    except PySparkException:
        return True
    return False


def _like(spark: SparkSession, node: Node, editor: Editor) -> None:
    """A malformed pattern is NULL: a constant one is tried here, one of the record is looked at there."""
    pattern = node.children[LIKES[node.kind]]
    if pattern.is_constant():
        if _fails(spark, f"'' {editor.of(node)}"):
            editor.put(pattern.start, pattern.stop, "CAST(NULL AS STRING)")
        return
    if editor.text[pattern.stop : node.stop].strip(") \t\r\n"):
        raise ConditionError("is refused: LIKE with ESCAPE needs a constant pattern")
    own = editor.of(pattern)
    editor.put(pattern.start, pattern.stop, rf"(CASE WHEN ({own}) RLIKE r'^(?s:[^\\]|\\[\\_%])*+\z' THEN ({own}) END)")


def _patterns(spark: SparkSession, node: Node, editor: Editor) -> None:
    for place in PATTERN_ARGUMENTS.get(node.name, ()):
        if place < len(node.children):
            argument = node.children[place]
            if _problem(spark, editor, argument) is not None:
                editor.put(argument.start, argument.stop, "CAST(NULL AS STRING)")


def _problem(spark: SparkSession, editor: Editor, argument: Node) -> str | None:
    text = editor.of(argument)
    if not argument.is_constant():
        raise ConditionError(f"is refused: the pattern {text} must be a constant")
    try:
        pattern = spark.sql("SELECT 1 AS one").select(F.expr(text).cast("string")).first()[0]
    except PySparkException:
        raise ConditionError(f"is refused: the pattern {text} must be a constant") from None
    return None if pattern is None else java_pattern_problem(spark, pattern)


def _receiver(sample: DataFrame, node: Node, editor: Editor) -> None:
    """Lead a call to the form of the function that takes what it is called on.

    A text or a list has forms of its own; a struct such as ``Log`` is taken as the map of its fields,
    of which those that are no texts have no value.
    """
    if not node.children:
        return
    first = node.children[0]
    receiver = editor.of(first)
    try:
        kind = sample.select(F.expr(receiver).alias("r")).schema[0].dataType
    except PySparkException:
        return  # the whole condition is refused later, with its own message
    if isinstance(kind, StructType):
        pairs = ", ".join(
            f"'{f.name}', " + (f"({receiver}).{f.name}" if isinstance(f.dataType, StringType) else "CAST(NULL AS STRING)")
            for f in kind
        )
        editor.put(first.start, first.stop, f"map({pairs})")
    elif node.name in WIDE_RECEIVERS and isinstance(kind, (StringType, ArrayType)):
        form = "text" if isinstance(kind, StringType) else "list"
        editor.put(node.start, node.start + len(node.name), f"{node.name}_{form}")


def _network(
    spark: SparkSession, sample: DataFrame, node: Node, editor: Editor, addresses: dict[str, str]
) -> None:
    """``in_cidr`` with a constant network as a test on the bits of the address."""
    if len(node.children) != 2 or not node.children[1].is_constant():
        return
    address, network = (editor.of(c) for c in node.children)
    try:
        row = spark.sql("SELECT 1 AS one").select(
            F.expr(f"ip_bits(split_part({network}, '/', 1))"), F.expr(f"cidr_prefix({network})")
        ).first()
        sample.select(F.expr(address))
    except PySparkException:
        return
    if row[0] is None or row[1] is None:
        test = "CAST(NULL AS BOOLEAN)"
    else:
        column = addresses.setdefault(address, f"_address_{len(addresses)}")
        if row[1] < len(row[0]):
            test = f"startswith({column}, '{row[0][: row[1] + 1]}')"
        else:  # no such prefix in the network's family; addresses of the other one are outside
            test = f"(CASE WHEN left({column}, 1) <> '{row[0][0]}' THEN false END)"
    editor.put(node.start, node.stop, test)
