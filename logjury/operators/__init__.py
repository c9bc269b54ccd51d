from logjury.operators.evaluate import compile_rules, evaluate, evaluate_table
from logjury.operators.judge import decide, judge, recent, status, with_ids
from logjury.operators.networks import longest_networks
from logjury.operators.normalize import BUILTIN, counted, normalize, unparsed
from logjury.operators.numbering import number
from logjury.operators.rules import (
    Action,
    Fragment,
    Group,
    Handler,
    PatternSet,
    Rule,
    RuleError,
    RuleSet,
    merge,
    validate_group_table,
    validate_handler_table,
    validate_rule_table,
)
from logjury.operators.tables import at_generation, merged_conditions

__all__ = [
    "BUILTIN",
    "Action",
    "Fragment",
    "Group",
    "Handler",
    "PatternSet",
    "Rule",
    "RuleError",
    "RuleSet",
    "at_generation",
    "compile_rules",
    "counted",
    "decide",
    "evaluate",
    "evaluate_table",
    "judge",
    "longest_networks",
    "merge",
    "merged_conditions",
    "normalize",
    "number",
    "recent",
    "status",
    "unparsed",
    "validate_group_table",
    "validate_handler_table",
    "validate_rule_table",
    "with_ids",
]
