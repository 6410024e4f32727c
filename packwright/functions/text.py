"""Scalar expressions over text and paths. All are built-in functions, so they stay within generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from packwright.functions import fixed

# Language by file suffix.
LANGUAGES = {"py": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "rs": "rust", "java": "java", "cs": "csharp", "go": "go", "rb": "ruby", "cpp": "cpp", "c": "c", "h": "c", "md": "markdown", "json": "json"}
# Kinds of secrets and the patterns that show them.
SECRETS = {
    "openai_api_key": r"sk-[A-Za-z0-9_-]{16,}",
    "aws_access_key": r"AKIA[0-9A-Z]{16}",
    "api_key": r"(?i)api[_-]?key\s*[:=]\s*[\"']?[A-Za-z0-9_-]{20,}",
    "password": r"(?i)password\s*[:=]\s*[\"']?[^\s\"']{4,}",
    "secret": r"(?i)(?:secret|token)\s*[:=]\s*[\"']?[A-Za-z0-9_-]{8,}",
}
_WORD = r"[a-zA-Z_][a-zA-Z0-9_]*"


def identifier_parts(text: Column) -> Column:
    """Identifiers (which start with a letter or underscore) cut at case changes and underscores, lower-cased, distinct; two characters or more, not all digits.

    Two replacements instead of look-around, so that any regex engine agrees."""
    names = F.array_join(F.regexp_extract_all(text, F.lit(_WORD), F.lit(0)), " ")
    cut = F.regexp_replace(F.regexp_replace(names, "([a-z0-9])([A-Z])", "$1_$2"), "([A-Z])([A-Z][a-z])", "$1_$2")
    return F.filter(F.array_distinct(F.split(F.lower(cut), "[ _]+")), lambda t: (F.length(t) >= 2) & ~t.rlike("^[0-9]+$"))


def lexical_terms(text: Column) -> Column:
    """Terms for BM25: the parts of identifiers; one empty term where none is left."""
    # The one-element transform binds the list to a name, so that it is made once.
    return F.get(F.transform(F.array(identifier_parts(text)), lambda t: F.when(F.size(t) > 0, t).otherwise(F.array(F.lit("")))), F.lit(0))


def query_terms(text: Column) -> Column:
    """Terms of a query for BM25: parts of identifiers that aren't stop words."""
    return F.array_except(identifier_parts(text), F.array(*map(F.lit, sorted(fixed.CODE_STOP_WORDS))))


def query_tokens(text: Column) -> Column:
    """Identifiers of a query, lower-cased, of three characters or more, that aren't stop words, in order of the alphabet."""
    names = F.transform(F.filter(F.regexp_extract_all(text, F.lit(_WORD), F.lit(0)), lambda t: F.length(t) >= 3), F.lower)
    return F.array_sort(F.array_except(F.array_distinct(names), F.array(*map(F.lit, sorted(fixed.STOP_WORDS)))))


def graph_intent(query: Column) -> tuple[Column, Column]:
    """callers_of, impact_of or none, and the first identifier of the query (dots kept) that isn't a word of the question; empty without an intent."""
    said = F.coalesce(query, F.lit(""))
    kind = F.when(said.rlike("(?i)" + fixed.CALLERS) | said.rlike("(?i)" + fixed.DEFINED), "callers_of").when(said.rlike("(?i)" + fixed.IMPACT), "impact_of").otherwise("none")
    named = F.filter(F.regexp_extract_all(said, F.lit(fixed.IDENTIFIER), F.lit(0)), lambda t: ~F.lower(t).isin(*fixed.ASKING))
    return kind, F.when(kind == "none", "").otherwise(F.coalesce(F.get(named, F.lit(0)), F.lit("")))


def byte_text(n: Column) -> Column:
    """A number of bytes in the largest unit that leaves one or more, to two places."""
    out = F.concat(F.format_string("%.2f", n / 1024.0**4), F.lit(" TB"))
    for power, unit in ((3, "GB"), (2, "MB"), (1, "KB"), (0, "B")):
        out = F.when(n < 1024.0 ** (power + 1), F.concat(F.format_string("%.2f", n / 1024.0**power), F.lit(f" {unit}"))).otherwise(out)
    return out


def path_parts(path: Column) -> Column:
    return F.split(F.lower(path), "[/_\\-.]")


def content_hash(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / 4)


def symbol_kind(name: Column) -> Column:
    return F.when(name.rlike(r"^\p{Lu}"), "class").otherwise("function")


def node_id(path: Column, symbol: Column | None = None, root: str = "") -> Column:
    """Path without ./ and with forward slashes, below root where it starts with that; a symbol follows after #, other characters of it as _."""
    clean = F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"^(\./)+", "")
    if root:
        clean = F.when(clean.startswith(root.rstrip("/") + "/"), F.substr(clean, F.lit(len(root.rstrip("/")) + 2))).otherwise(clean)
    return clean if symbol is None else F.concat_ws("#", clean, F.regexp_replace(symbol, "[^A-Za-z0-9_]", "_"))


def infer_domain(path: Column, keywords: list[str]) -> Column:
    """The first whole part of the path that is a keyword, else general."""
    known = F.array(*[F.lit(k) for k in keywords])
    return F.coalesce(F.get(F.filter(F.split(F.lower(path), "/"), lambda p: F.array_contains(known, p)), F.lit(0)), F.lit("general"))


def summary_line(text: Column, width: int = 140) -> Column:
    """The first line that isn't empty or a comment, cut to width."""
    # F.trim alone would be given each line's number as what to trim.
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith("#") & ~x.startswith("//"))
    return F.coalesce(F.substring(F.get(lines, F.lit(0)), 1, width), F.lit(""))


def language_of(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(F.element_at(table, F.regexp_extract(F.lower(path), r"\.([a-z]+)$", 1)), F.lit("text"))


def line_count(text: Column) -> Column:
    return F.when(text == "", 0).otherwise(F.size(F.split(text, "\n")) - F.when(text.endswith("\n"), 1).otherwise(0))


def module_suffixes(path: Column) -> Column:
    """Dotted names of a module, longest first: no extension, no leading src."""
    parts = F.split(F.regexp_replace(F.regexp_replace(path, r"\.[^./]*$", ""), "^src/", ""), "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts) - i + 1), "."))


def secrets_found(text: Column) -> Column:
    """Names of the kinds of secrets in a text."""
    return F.filter(F.array(*[F.when(text.rlike(p), F.lit(k)) for k, p in SECRETS.items()]), lambda k: k.isNotNull())


def redact(text: Column) -> Column:
    for kind, pattern in SECRETS.items():
        text = F.regexp_replace(text, pattern, f"[REDACTED:{kind}]")
    return text


def xml_escape(text: Column) -> Column:
    for raw, said in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(raw), F.lit(said))
    return text


def wrap_untrusted(path: Column, text: Column, token: str) -> Column:
    """Content between marks that carry a token the content can't know, the first with its path."""
    return F.concat(F.lit(f"CTX_{token}:content_start:"), path, F.lit("\n"), text, F.lit(f"\nCTX_{token}:content_end"))
