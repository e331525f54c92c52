"""Detection rules as data: what to match, what to write instead, when to bother.

A rule's ``needs`` is a cheap necessary condition on the raw text. A tuple means "contains one of
these literals"; a string is a short pattern. Texts that fail it skip the full pattern. No marker can
create a substring that a ``needs`` looks for and a pattern then completes, so the condition may be
tested on the raw text even when earlier rules have already replaced parts of it.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F


# In Java's patterns: white space, digits, word characters and case as Unicode has them.
UNICODE = "(?U)"


@dataclass(frozen=True)
class Rule:
    name: str
    pattern: str
    marker: str
    needs: tuple[str, ...] | str

    @property
    def spark_pattern(self) -> str:
        return HEADS.get(self.pattern.removeprefix("(?i)"), "") + UNICODE + self.pattern

    def possible(self, text: Column) -> Column:
        if isinstance(self.needs, str):
            return text.rlike(UNICODE + self.needs)
        return reduce(or_, [text.contains(word) for word in self.needs])

    def count(self, text: Column) -> Column:
        return F.regexp_count(text, F.lit(self.spark_pattern))

    def if_possible(self, text: Column, value: Column, default: Column) -> Column:
        """``value`` after ``needs`` where that is a search for literals: a pattern would take as long as the rule itself."""
        return F.coalesce(value if isinstance(self.needs, str) else F.when(self.possible(text), value), default)

    @property
    def by_lines(self) -> bool:
        """Whether it finds in ``told_lines`` what it finds in the text."""
        return self.pattern.removeprefix("(?i)") in _BY_LINES


# Patterns that decide which characters count as personal data or secrets.
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
PHONE_US = r"\b(?:\+?1[-.]?)?\(?([0-9]{3})\)?[-.]?([0-9]{3})[-.]?([0-9]{4})\b"
PHONE_ZA = r"\b(?:\+?27|0)(?:\s*\d){9}\b"
PREFIXED_KEY = r"\b(?:sk-|pk_|key-)[a-zA-Z0-9]{20,}\b"
ASSIGNED_KEY = (
    r"\b(?:api[_-]?key|apikey|access[_-]?token|secret[_-]?key)"
    r"""[\s:=]+["']?([A-Za-z0-9_\-]{20,})["']?\b"""
)
AWS_KEY_SHORT = r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b"
AWS_KEY_LONG = r"\b(?:AKIA|A3T|AGPA|AIDA|AROA|AIPA|ANPA|ANVA|ASIA)[A-Z0-9]{16}\b"
CREDIT_CARD = r"\b(?:4[0-9]{12}(?:[0-9]{3})?|5[1-5][0-9]{14}|3[47][0-9]{13})\b"
SSN = r"\b\d{3}-\d{2}-\d{4}\b"
IP_ADDRESS = r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b"
BEARER = r"\bBearer\s+[A-Za-z0-9\-._~+/]+=*\b"
SLACK_TOKEN = r"\bxox[baprs]-[0-9]{10,13}-[0-9]{10,13}-[A-Za-z0-9]{24,}\b"
OPENAI_KEY = r"\bsk-[A-Za-z0-9]{48}\b"
ANTHROPIC_KEY = r"\bsk-ant-[A-Za-z0-9\-]{95,}\b"
ID_NUMBER = r"\b(?:(?:19|20)\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01]))\d{7}\b"
JWT = r"\beyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\b"

# Rules of our own for the extended set.
ID_NUMBER_13 = r"\b[0-9]{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12][0-9]|3[01])[0-9]{7}\b"
PHONE_INTL = r"\+[0-9]{1,3} \([0-9]{3}\) [0-9]{3}-[0-9]{4}\b"
TOKEN_ASSIGNMENT = r"""\b(?:token|secret)\s*[:=]\s*["']?[A-Za-z0-9_\-]{20,}["']?"""

# What holds wherever a match begins, told from single characters: most places are left before the word boundary, which is slow as Unicode
# has it. They follow from the patterns, in any case (long s is an s, the Kelvin sign a k), and change no match.
_AFTER_NO_WORD = "(?<![A-Za-z0-9_])"
HEADS = {
    PHONE_US: "(?=[+(0-9])",
    PHONE_ZA: "(?=[+20])",
    PREFIXED_KEY: "(?=[spk])" + _AFTER_NO_WORD,
    ASSIGNED_KEY: "(?=[aAsS\u017f])" + _AFTER_NO_WORD,
    AWS_KEY_SHORT: "(?=A)" + _AFTER_NO_WORD,
    AWS_KEY_LONG: "(?=[aA])" + _AFTER_NO_WORD,
    CREDIT_CARD: "(?=[345])" + _AFTER_NO_WORD,
    IP_ADDRESS: "(?=[0-9])" + _AFTER_NO_WORD,
    BEARER: "(?=B)" + _AFTER_NO_WORD,
    SLACK_TOKEN: "(?=[xX][oO])" + _AFTER_NO_WORD,
    OPENAI_KEY: "(?=[sS\u017f][kK\u212a]-)" + _AFTER_NO_WORD,
    ANTHROPIC_KEY: "(?=[sS\u017f][kK\u212a]-)" + _AFTER_NO_WORD,
    ID_NUMBER: "(?=19|20)" + _AFTER_NO_WORD,
    JWT: "(?=[eE][yY][jJ])" + _AFTER_NO_WORD,
    ID_NUMBER_13: "(?=[0-9])" + _AFTER_NO_WORD,
    TOKEN_ASSIGNMENT: "(?=[tTsS\u017f])" + _AFTER_NO_WORD,
}

# Patterns of which each line of a match, and each line between its lines, meets _PART: one with an at sign, a digit, a long word, the words
# of an assignment, or nothing but white space and the signs between. No match holds a number sign.
_BY_LINES = {
    EMAIL, PHONE_US, PHONE_ZA, PREFIXED_KEY, ASSIGNED_KEY, AWS_KEY_SHORT, AWS_KEY_LONG, CREDIT_CARD, SSN, IP_ADDRESS, SLACK_TOKEN,
    OPENAI_KEY, ANTHROPIC_KEY, ID_NUMBER, JWT, ID_NUMBER_13, PHONE_INTL,
}
_PART = (
    r"[@\p{Nd}]|(?<!\S)\S{19}|(?=[kKtTeE\u212a])(?:[kK\u212a][eE][yY]|[tT][oO][kK\u212a][eE]|[eE][yY][jJ])|\A(?U:[\s:=]*)\z"
)


def told_lines(text: Column) -> Column:
    """The text with a number sign for each line that can hold no part of a match of a rule ``by_lines``; lines keep their numbers."""
    return F.array_join(F.transform(F.split(text, "\n", -1), lambda line: F.when(line.rlike(_PART), line).otherwise("#")), "\n")


# The same for these two as well, but for a bearer and a token on different lines, where that token may be any word.
_PART_MORE = _PART + r"|Bearer|(?i:(?u:secret))"
_PARTED = UNICODE + r"Bearer\s*\n"


def by_told_lines(rules: tuple[Rule, ...]) -> bool:
    """Whether every rule finds in the lines of ``lines_told``, and between their replacements, what it finds in a text that is not ``parted``."""
    return all(rule.by_lines or rule.pattern.removeprefix("(?i)") in (BEARER, TOKEN_ASSIGNMENT) for rule in rules)


def lines_told(text: Column) -> Column:
    """Array of {line, told}: the lines, and whether each can hold a part of a match."""
    return F.transform(F.split(text, "\n", -1), lambda line: F.struct(line.alias("line"), line.rlike(_PART_MORE).alias("told")))


def parted(text: Column) -> Column:
    return text.contains("Bearer") & text.rlike(_PARTED)


_SEPARATED_DIGITS = "[0-9][-.]?[0-9]{4}"

# The eight redaction types in the order their passes run.
REDACTOR = (
    Rule("email", EMAIL, "[EMAIL_REDACTED]", ("@",)),
    Rule("phone", PHONE_US, "[PHONE_REDACTED]", _SEPARATED_DIGITS),
    Rule("api_key", PREFIXED_KEY, "[API_KEY_REDACTED]", ("sk-", "pk_", "key-")),
    Rule("aws_key", AWS_KEY_SHORT, "[AWS_KEY_REDACTED]", ("AKIA", "ASIA")),
    Rule("credit_card", CREDIT_CARD, "[CREDIT_CARD_REDACTED]", "[0-9]{13}"),
    Rule("ssn", SSN, "[SSN_REDACTED]", r"-\d{2}-"),
    Rule("ip_address", IP_ADDRESS, "[IP_REDACTED]", r"[0-9]\.[0-9]"),
    Rule("bearer_token", BEARER, "[BEARER_TOKEN_REDACTED]", ("Bearer",)),
)


def _any_case(name: str, pattern: str, needs: tuple[str, ...] | str) -> Rule:
    needs = needs if isinstance(needs, tuple) else "(?i)" + needs
    return Rule(name, "(?i)" + pattern, f"[{name.upper()}_REDACTED]", needs)


# The eleven scan types, all ignoring case, in scan order.
SCANNER = (
    _any_case("email", EMAIL, ("@",)),
    _any_case("phone", PHONE_ZA, r"\d\s*\d\s*\d"),
    _any_case("api_key", ASSIGNED_KEY, "key|token"),
    _any_case("slack_token", SLACK_TOKEN, "xox[baprs]-"),
    _any_case("aws_key", AWS_KEY_LONG, "a[3gikrns][dioptv][a-z0-9]{16}"),
    _any_case("openai_key", OPENAI_KEY, "sk-"),
    _any_case("anthropic_key", ANTHROPIC_KEY, "sk-ant-"),
    _any_case("id_number", ID_NUMBER, r"\d{15}"),
    _any_case("credit_card", CREDIT_CARD, "[0-9]{13}"),
    _any_case("ip_address", IP_ADDRESS, r"[0-9]\.[0-9]"),
    _any_case("jwt_token", JWT, "eyj"),
)

# Scan types that must not reach the embeddings.
CRITICAL_TYPES = (
    "api_key",
    "slack_token",
    "aws_key",
    "openai_key",
    "anthropic_key",
    "id_number",
    "credit_card",
    "jwt_token",
)


def _named(rules: tuple[Rule, ...], name: str) -> Rule:
    return next(rule for rule in rules if rule.name == name)


def _renamed(rule: Rule, name: str) -> Rule:
    return Rule(name, rule.pattern, f"[{name.upper()}_REDACTED]", rule.needs)


# Union of the two sets plus three rules of our own; the most specific come first and the phone
# rules last, because they would eat the digits of the others.
EXTENDED = (
    _named(SCANNER, "jwt_token"),
    _named(SCANNER, "slack_token"),
    _named(SCANNER, "anthropic_key"),
    _named(SCANNER, "openai_key"),
    _named(REDACTOR, "api_key"),
    _renamed(_named(SCANNER, "api_key"), "assigned_key"),
    _any_case("token_assignment", TOKEN_ASSIGNMENT, "token|secret"),
    _named(REDACTOR, "bearer_token"),
    _named(SCANNER, "aws_key"),
    _named(REDACTOR, "email"),
    _named(REDACTOR, "credit_card"),
    _named(SCANNER, "id_number"),
    Rule("id_number_13", ID_NUMBER_13, "[ID_NUMBER_13_REDACTED]", "[0-9]{13}"),
    _named(REDACTOR, "ssn"),
    _named(REDACTOR, "ip_address"),
    Rule("phone_intl", PHONE_INTL, "[PHONE_INTL_REDACTED]", (" (",)),
    _renamed(_named(SCANNER, "phone"), "phone_za"),
    _named(REDACTOR, "phone"),
)

RULE_SETS = {"redactor": REDACTOR, "scanner": SCANNER, "extended": EXTENDED}


def pick_rules(rules: str | tuple[Rule, ...], types: list[str] | None = None) -> tuple[Rule, ...]:
    """Rules of a named set (or given rules), kept in order, optionally only some types."""
    chosen = RULE_SETS[rules] if isinstance(rules, str) else tuple(rules)
    if types is None:
        return chosen
    unknown = set(types) - {rule.name for rule in chosen}
    if unknown:
        raise ValueError(f"unknown rule types: {sorted(unknown)}")
    return tuple(rule for rule in chosen if rule.name in types)
