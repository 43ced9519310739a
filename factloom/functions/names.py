"""Names, texts, paths: column functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SIGILS = "$@%&"


def sigil(name: Column) -> Column:
    return F.regexp_extract(name, r"^[$@%&]", 0)


def strip_sigils(name: Column) -> Column:
    return F.regexp_replace(name, r"^[$@%&]+", "")


def match_key(name: Column) -> Column:
    """The unqualified name with its leading sigil: what both sides of a lookup compare."""
    return F.concat(sigil(name), F.substring_index(F.regexp_replace(name, r"^[$@%&]", ""), "::", -1))


def qualifier(name: Column) -> Column:
    """What stands before the last ::, or null."""
    return F.when(F.contains(name, F.lit("::")), F.regexp_replace(F.regexp_replace(name, r"^[$@%&]", ""), r"::[^:]*$", ""))


def unqualified(name: Column) -> Column:
    return F.substring_index(name, "::", -1)


def package_agrees(relative: bool, a: Column, b: Column) -> Column:
    """Equal packages (null with null), or one a suffix of the other where relative."""
    if not relative:
        return a.eqNullSafe(b)
    return a.eqNullSafe(b) | F.coalesce(a.endswith(F.concat(F.lit("::"), b)) | b.endswith(F.concat(F.lit("::"), a)), F.lit(False))


def is_class_name(text: Column) -> Column:
    return text.rlike(r"^[A-Za-z_][A-Za-z0-9_]*(::[A-Za-z_][A-Za-z0-9_]*)*$")


def is_identifier(text: Column) -> Column:
    return text.rlike(r"^[A-Za-z_][A-Za-z0-9_]*$")


#: Conventional names of receivers and constructors.
INVOCANTS = ("$self", "$class", "$this", "$proto")
CONSTRUCTORS = ("new",)


def is_invocant(name: Column) -> Column:
    return name.isin(*INVOCANTS)


def is_constructor(name: Column) -> Column:
    return name.isin(*CONSTRUCTORS)


def method_token(token: Column) -> Column:
    """bare, qualified or super."""
    return F.when(token.startswith("SUPER::"), "super").when(F.contains(token, F.lit("::")), "qualified").otherwise("bare")


def word_at(line: Column, col0: Column) -> Column:
    """The word around a 0-based column."""
    before = F.regexp_extract(F.substring(line, F.lit(1), col0), r"\w*\z", 0)
    return F.concat(before, F.regexp_extract(line.substr(col0 + 1, F.length(line)), r"^\w*", 0))


def is_call(line: Column, word: Column) -> Column:
    """Whether a word is followed by an opening bracket."""
    return F.regexp_like(line, F.concat(F.lit(r"\b\Q"), word, F.lit(r"\E\s*\(")))


def affixed(prefix: Column, new: Column, suffix: Column) -> Column:
    return F.concat(prefix, new, suffix)


def apply_edits(text: Column, edits: Column) -> Column:
    """Replace spans (array of struct(start, size, new), 0-based) from the last to the first."""
    ordered = F.reverse(F.array_sort(edits))
    return F.aggregate(ordered, text, lambda acc, e: F.concat(acc.substr(F.lit(1), e["start"]), e["new"], acc.substr(e["start"] + e["size"] + 1, F.length(acc))))


def byte_column(line: Column, char_col: Column) -> Column:
    """Byte offset of a 0-based character column."""
    return F.octet_length(line.substr(F.lit(1), char_col))


def digest12(text: Column) -> Column:
    return F.left(F.sha2(text, 256), F.lit(12))


def hash_share(*parts: Column) -> Column:
    """A fixed share in [0, 1) from the identity of a sample: 48 bits, exact in a double."""
    return F.conv(F.substring(F.sha2(F.concat_ws("\u0000", *parts), 256), 1, 12), 16, 10).cast("double") / float(1 << 48)


def urls(text: Column) -> Column:
    """Links of a text, without the punctuation that ends a sentence."""
    found = F.regexp_extract_all(text, F.lit(r"https?://[^\s<>\"']+"), F.lit(0))
    return F.transform(found, lambda u: F.regexp_replace(u, r"[.,;:)\]]+$", ""))


def csv_escaped(text: Column) -> Column:
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.rlike('[",\n\r]'), quoted).otherwise(text)


def html_escaped(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def relative_path(path: Column, root: Column) -> Column:
    return F.when(path.startswith(F.concat(root, F.lit("/"))), path.substr(F.length(root) + 2, F.length(path))).otherwise(path)


def element_at_wrapped(items: Column, i: Column) -> Column:
    """0-based, negative from the end, null outside."""
    return F.try_element_at(items, F.when(i >= 0, i + 1).otherwise(i))


def even_positions(items: Column) -> Column:
    """Keys of a flat list of pairs."""
    return F.filter(items, lambda x, i: i % 2 == 0)


def signature(name: Column, params: Column, is_method: Column) -> Column:
    """name(a, b): without the receiver of a method."""
    shown = F.when(is_method & is_invocant(F.get(params, F.lit(0))), F.slice(params, F.lit(2), F.greatest(F.size(params) - 1, F.lit(0)))).otherwise(params)
    return F.concat(name, F.lit("("), F.array_join(shown, ", "), F.lit(")"))


def severity_rank(severity: Column) -> Column:
    from factloom.model import SEVERITIES

    out = F.lit(len(SEVERITIES))
    for i, s in enumerate(SEVERITIES):
        out = F.when(severity == s, i).otherwise(out)
    return out
