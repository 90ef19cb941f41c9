"""Constants, word lists, tables and patterns that results depend on, stated as they are."""

from __future__ import annotations

import string
import unicodedata
from functools import lru_cache
from typing import NamedTuple

# --- Fixed values: white space as str.split() sees it, by code point. ---
WHITE_SPACE = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)

# --- Fixed values: word counting. ---
STRIP_CHARS = "\"'“”‘’.,!?;:()[]{}<>…«»—–-*`~"
#: Letters and numeric characters that aren't decimal digits, in runs joined by single apostrophes or hyphens.
WORD = r"[\p{L}\p{Nl}\p{No}]+(?:['’-][\p{L}\p{Nl}\p{No}]+)*"
EXCLUDED_TOKEN = (
    r"://"
    r"|^[Ww][Ww][Ww]\."
    r"|@[\p{L}\p{N}_-]+\."
    r"|^(?:/|~|\.{1,2}/|[A-Za-z]:[\\/])"
    r"|[\\/].*[\\/]"
    r"|^[\p{L}\p{N}_-]+\.[A-Za-z][\p{L}\p{N}_]{0,3}$"
    r"|[a-z][A-Z][a-z]"
    r"|[_{}()\[\];=<>`$#|&*%^]"
)

# --- Fixed values: English classification. ---
NON_LATIN_LETTER_PERCENT_LIMIT = 30
MIN_REMAINDER_WORDS = 3
REASONS = ("no_letters", "no_ascii_letters", "latin_script", "non_latin_share_exceeded", "token_mixes_scripts", "remainder_below_minimum", "non_latin_tokens_stripped")

# --- Fixed values: pasted documents and flags. ---
PASTED_MIN_LINES, PASTED_MAX_LINES = 80, 150
PASTED_STRUCTURE = r"(?m)^(#{1,6} |\s*[-*]\s|\s*\d+\.\s)"
LONG_PASTE_CHARS = 2000

# --- Fixed values: deduplication. ---
FUZZY_RATIO = 0.92
PROXIMITY_SECONDS = 600

# --- Fixed values: privacy patterns. \w, \d, \s and \b are Unicode-aware: (?U). ---
ABBREVIATIONS_NOT_DOMAINS = ("et.al", "op.cit", "loc.cit", "sq.ft", "cu.ft", "sq.mi")
PATH_ROOTS = ("bin", "build", "config", "dist", "etc", "lib", "node_modules", "opt", "packages", "scripts", "src", "srv", "tmp", "usr", "var", "vendor")
URL = r"(?U)(?i:(?:https?://|www\.)\S+)|(?i:\b[a-z0-9](?:[a-z0-9-]*[a-z0-9])?\.[a-z]{2,24}\b)"
EMAIL = r"(?U)\b[\w.+-]+@[\w-]+\.[\w.-]+\b"
PHONE = r"(?U)(?<!\w)\+?\d[\d\s().-]{6,}\d(?!\w)"
PATH = (
    r"(?Um)(?:^|(?<=[\s\"'(\[]))(?:~|\.{1,2})?/[\w.-]+(?:/[\w.-]+)*"
    r"|\b[A-Za-z]:[\\/][\w.\\/-]*"
    r"|\\\\[\w.-]+\\[\w.\\-]*"
    r"|\b[\w.-]+(?:/[\w.-]+)*/[\w-]+\.[A-Za-z0-9]{1,8}\b"
    r"|\b(?:" + "|".join(PATH_ROOTS) + r")/[\w.-]+(?:/[\w.-]+)*"
)
CREDENTIAL = (
    r"(?U)\b(?:sk|pk|rk)-[A-Za-z0-9_-]{8,}"
    r"|\bgh[pousr]_[A-Za-z0-9]{8,}"
    r"|\bxox[a-z]-[A-Za-z0-9-]+"
    r"|\bAKIA[A-Z0-9]{8,}"
    r"|\bAIza[A-Za-z0-9_-]{8,}"
    r"|BEGIN [A-Z ]*PRIVATE KEY"
    r"|\beyJ[A-Za-z0-9_-]{10,}"
)
IDENTIFIER = (
    r"(?Ui)\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b"
    r"|\b[0-9a-f]{16,}\b"
    r"|\b(?=[0-9a-f]*[0-9])(?=[0-9a-f]*[a-f])[0-9a-f]{8,}\b"
    r"|\b[A-Za-z0-9+/]{24,}={0,2}"
)
CODE_PARTS = (
    r"[{}]",
    r";\s*$",
    r"=>|==|!=|::|\+=|->",
    r"```",
    r"\b(?:def|const|elif|func|var)\s",
    r"(?:^|\n)[ \t]*(?:class|import|from|function|return|let)\b",
    r"(?i:(?<!the )(?<!an )(?<!a )(?<!its )(?<!our )(?<!any )(?<!each ))\bimport\s+[a-z_][a-z0-9_.]*\b",
    r"\b(?:class|function)\s+\w+\s*[({:]",
    r"\breturn\s+\w+\s*;",
    r"\blet\s+\w+\s*=",
    r"\b\w+_\w+\(",
    r"\b\w+\.\w+\(",
    r"\)\s*;",
)
CODE = "(?Um)" + "|".join(CODE_PARTS)
NUMBER = r"(?U)\d{3,}|\d+(?:[.,]\d+)+|\d+\s?%|[$€£¥]\s?\d+|\d+\s?(?:USD|EUR|GBP)\b"
CONTEXT_DEPENDENT = (
    r"(?Ui)\bin this (?:case|sentence|example|context)\b"
    r"|\bthe example\b"
    r"|\bthis (?:sentence|phrase|message)\b"
    r"|\babove\b"
    r"|\bhere the\b"
    r"|\b(?:as used|shown|written|used) here\b"
    r"|(?:^|(?<=[.!?])\s+)here\b"
    r"|\bhere\s*(?=[.,;:!?]|$)"
)
#: Codes in the order in which a scan reports them.
PRIVACY_CHECKS = (
    ("PRIVACY_URL_PRESENT", URL),
    ("PRIVACY_EMAIL_PRESENT", EMAIL),
    ("PRIVACY_CREDENTIAL_PATTERN", CREDENTIAL),
    ("PRIVACY_IDENTIFIER_PRESENT", IDENTIFIER),
    ("PRIVACY_PATH_PRESENT", PATH),
    ("PRIVACY_PHONE_PRESENT", PHONE),
    ("PRIVACY_CODE_PRESENT", CODE),
    ("PRIVACY_SUSPICIOUS_NUMBER", NUMBER),
)
#: The literals that a text must hold for a part of CODE to match: one of each group.
CODE_LITERALS = (
    (("{", "}"),),
    ((";",),),
    (("=>", "==", "!=", "::", "+=", "->"),),
    (("```",),),
    (("def", "const", "elif", "func", "var"),),
    (("class", "import", "from", "function", "return", "let"),),
    (("import",),),
    (("class", "function"), ("(", "{", ":")),
    (("return",), (";",)),
    (("let",), ("=",)),
    (("_",), ("(",)),
    ((".",), ("(",)),
    ((")",), (";",)),
)


class Part(NamedTuple):
    """A part of a privacy check. A text that ``pattern`` matches holds one literal of each group and, after a line break, matches the sketch: a pattern
    that starts at rare characters and so costs little where it finds nothing."""

    pattern: str
    literals: tuple[tuple[str, ...], ...] = ()
    sketch: str | None = None
    ascii_sketch: str | None = None  # where it isn't the sketch without (?U)


_ALNUM = string.ascii_letters + string.digits
_NO_ALNUM = "".join(f"\\x{i:02X}" for i in range(128) if chr(i) not in _ALNUM)
#: A run that long follows another character. Java tells single characters of a class faster than ranges.
_RUNS = f"(?:[{string.hexdigits}]{{8}}|[{_ALNUM}+/%s]{{24}})"
#: Without regard to case, i, k and s are also these letters; hexadecimal digits have no such forms.
_ODD_CASES = ("\u0130", "\u0131", "\u017F", "\u212A")
_CODE_SKETCHES = {5: r"[\n\r\u0085\u2028\u2029][ \t]*(?:class|import|from|function|return|let)", 11: r"(?U)\.\w+\("}
#: The checks in parts, of which any may match.
PRIVACY_PARTS = {
    "PRIVACY_URL_PRESENT": (Part(URL, (), r"(?Ui)[.:](?:(?<=\.)[a-z]{2}|(?<=www\.)\S|(?<=:)//\S)"),),
    "PRIVACY_EMAIL_PRESENT": (Part(EMAIL, (("@",),), r"(?U)@[\w-]+\.[\w.-]"),),
    "PRIVACY_CREDENTIAL_PATTERN": (Part(CREDENTIAL, (("sk-", "pk-", "rk-", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xox", "AKIA", "AIza", "PRIVATE KEY", "eyJ"),)),),
    "PRIVACY_IDENTIFIER_PRESENT": (
        Part(IDENTIFIER, (), f"[^{_ALNUM}]" + _RUNS % "", f"[{_NO_ALNUM}]" + _RUNS % ""),
        Part(IDENTIFIER, (_ODD_CASES,), f"[^{_ALNUM}]" + _RUNS % "".join(_ODD_CASES)),
    ),
    "PRIVACY_PATH_PRESENT": (
        Part(
            PATH,
            (("/", "\\"),),
            r"(?Um)[/\\](?:(?<=(?:^|[\s\"'(\[])(?:~|\.{1,2})?/)[\w.-]|(?<=/)[\w-]+\.[A-Za-z0-9]|(?<=[A-Za-z]:[/\\])|(?<=\\)\\[\w.-]|(?<=(?:" + "|".join(PATH_ROOTS) + r")/)[\w.-])",
        ),
    ),
    "PRIVACY_PHONE_PRESENT": (Part(PHONE, (), r"(?U)\d[\d\s().-]{6}"),),
    "PRIVACY_CODE_PRESENT": tuple(Part("(?Um)" + part, literals, _CODE_SKETCHES.get(i)) for i, (part, literals) in enumerate(zip(CODE_PARTS, CODE_LITERALS, strict=True))),
    "PRIVACY_SUSPICIOUS_NUMBER": (Part(NUMBER, (), r"(?U)\d(?:\d\d|[.,]\d|\s?%|\s?(?:USD|EUR|GBP)\b|(?<=[$€£¥]\s?\d))"),),
}
INVISIBLE = "PRIVACY_INVISIBLE_CHARACTER"
MAX_EXAMPLE_WORDS = 15
SOURCE_TYPES = ("aider", "claude_code", "cline", "codex", "cursor", "gemini_cli", "opencode", "roo_code", "wispr_flow")

# --- Fixed values: letters of other scripts and the Latin letters they look like. ---
LOOKALIKES = (
    ("авеѕіјкмнорстухһԁԛԝѡӏғԍ", "abesijkmhopctyxhdqwwlfg"),
    ("АВЕЅІЈКМНОРСТУХԀԚԜ", "ABESIJKMHOPCTYXDQW"),
    ("αονρτυκιμγχ", "aovptukiuyx"),
    ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "ABEZHIKMNOPTYX"),
)
#: Greek, Cyrillic and its supplement hold them all: one range is told faster than a hundred letters.
LOOKALIKE_RANGE = r"[\u0370-\u052F]"

# --- Fixed values: packages. ---
VERSION_FIELDS = ("client_version", "producer_version", "privacy_verifier_version")
WITHHELD_REASONS = ("WITHHELD_BY_USER", "WITHHELD_PRIVACY_UNSAFE", "WITHHELD_PROCESSING_FAILED")
VERSION_PATTERN = r"\A[0-9]+(\.[0-9]+)*\z"

# --- Fixed values: agent batches. ---
AGENT_RESERVE, AGENT_STEPS, DEFAULT_AGENT_CAP = 0.35, 3, 200
MAX_BATCH_SESSIONS, MIN_BATCH_WORDS, MAX_BATCH_WORDS = 25, 400, 8000
AGENT_STEPS_REMAINING = {"c": 3, "d": 2, "e": 1}
FOUND_TARGET = 240

# --- Fixed values: estimates. ---
PRESETS = (("last-7-days", 7), ("last-14-days", 14), ("last-30-days", 30), ("last-3-months", 91), ("last-year", 365), ("everything", None))
AUTHORED_WORD_RETENTION, AUTHORED_UTTERANCE_RETENTION = 0.48, 0.97
MESSAGES_PER_SESSION, CALIBRATED_BATCH_SIZE, HIGH_CONFIDENCE_MIN_RECORDS = 10, 25, 10
LOW_CONFIDENCE_WIDENING, MAD_CLAMP = 1.5, 3
SECONDS_PER_UNIT_LOW, SECONDS_PER_UNIT_HIGH = 4.2, 11.4
TOKENS_PER_MINUTE_LOW, TOKENS_PER_MINUTE_HIGH = 4000, 9000
TARGET_WORDS = 20_000


@lru_cache(maxsize=1)
def latin_class() -> str:
    """A regex class of all letters whose Unicode name starts with LATIN, built from the character database."""
    ranges: list[list[int]] = []
    for c in range(0x20000):
        if chr(c).isalpha() and unicodedata.name(chr(c), "").startswith("LATIN"):
            if ranges and ranges[-1][1] == c - 1:
                ranges[-1][1] = c
            else:
                ranges.append([c, c])
    return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges) + "]"


def white_space_class() -> str:
    return "[" + "".join(f"\\x{{{c:X}}}" for c in WHITE_SPACE) + "]"


# --- Fixed values: legal transitions of runs and of their steps. ---
RUN_TRANSITIONS = {
    "created": ("selecting", "expired"),
    "selecting": ("awaiting_preflight", "expired"),
    "awaiting_preflight": ("processing", "expired"),
    "processing": ("checkpointed", "blocked", "review", "completed_with_exclusions"),
    "checkpointed": ("processing", "awaiting_preflight", "expired"),
    "blocked": ("processing", "awaiting_preflight", "expired"),
    "review": ("completed", "completed_with_exclusions", "processing", "expired"),
    "completed": (),
    "completed_with_exclusions": (),
    "expired": (),
}
STEP_TRANSITIONS = {
    "pending": ("in_progress",),
    "in_progress": ("produced", "failed", "quarantined"),
    "produced": ("verified_deterministic", "failed"),
    "verified_deterministic": ("verified_semantic", "promoted", "failed"),
    "verified_semantic": ("promoted", "failed"),
    "promoted": ("in_progress", "invalidated"),
    "quarantined": ("in_progress",),
    "failed": ("in_progress",),
    "invalidated": ("in_progress",),
}
PROMOTION_PATH = ("in_progress", "produced", "verified_deterministic", "promoted")
ENDED = ("completed", "completed_with_exclusions", "expired")
RUNTIME_ADAPTERS = {"claude_code": "claude_code", "codex": "codex"}
RETENTION_DAYS = 30
RESTART_FIELDS = ("adapter_versions", "artifact_schema_version", "tokenizer_version", "consent_policy_version")
#: A changed field and the earliest step that it makes invalid.
DOWNSTREAM_FIELDS = (("skill_versions", "c"), ("prompt_versions", "c"), ("model_ids", "c"), ("client_version", "d"))
