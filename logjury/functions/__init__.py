from logjury.functions.json import JsonObject, first_field, open_object, text_map
from logjury.functions.predicates import register_functions
from logjury.functions.text import level_name, lower_ascii, strip, upper_ascii

__all__ = [
    "JsonObject",
    "first_field",
    "level_name",
    "lower_ascii",
    "open_object",
    "register_functions",
    "strip",
    "text_map",
    "upper_ascii",
]
