"""A small pack for texts of any language: numbers, contacts, licence lines.

The patterns mean the same in Java and RE2, so results can be compared with SQL.
"""

from wishgrid.functions.spans import Rule

RULES = [
    Rule("contact", r"[A-Za-z0-9._]+@[A-Za-z0-9.]+"),
    Rule("licence", r"[Ll]icen[sc]e[a-z]*"),
    Rule("number", r"[0-9]+"),
    Rule("word_number", r"[a-z]+ [0-9]+"),
]
