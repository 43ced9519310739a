"""Types as strings: Class:name, Optional<T>, Hash{…}, Array…, scalars; display and constraint spelling."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Constraint names and the types they stand for.
CONSTRAINTS = {"Int": "Numeric", "Num": "Numeric", "Str": "String", "Bool": "Bool", "HashRef": "HashRef", "ArrayRef": "ArrayRef", "CodeRef": "CodeRef", "RegexpRef": "Regexp"}


def optional_inner(t: Column) -> Column:
    return F.when(t.startswith("Optional<"), t.substr(F.lit(10), F.length(t) - 10)).otherwise(t)


def display(t: Column) -> Column:
    """A type for people."""
    inner = optional_inner(t)
    shown = F.when(inner.startswith("Class:"), inner.substr(F.lit(7), F.length(inner))).when(inner.startswith("Hash"), "HashRef").otherwise(inner)
    return F.when(t.isNull(), "unknown").when(t.startswith("Optional<"), F.concat(shown, F.lit(" or undef"))).otherwise(shown)


def constraint(spelt: Column) -> Column:
    """The type a constraint stands for; InstanceOf['X'] is class X, parameters of containers are dropped."""
    of = F.regexp_extract(spelt, r"^InstanceOf\[\s*['\"]?([\w:]+)", 1)
    head = F.regexp_extract(spelt, r"^\w+", 0)
    out = F.lit(None).cast("string")
    for name, t in CONSTRAINTS.items():
        out = F.when(head == name, t).otherwise(out)
    return F.when(of != "", F.concat(F.lit("Class:"), of)).otherwise(out)


def subsumes(wide: Column, narrow: Column) -> Column:
    """Equal, a hash over any hash, an array over any array, Numeric over Bool, Optional<T> over T."""
    return (wide == narrow) | ((wide == "HashRef") & narrow.startswith("Hash")) | ((wide == "ArrayRef") & (narrow.startswith("Array") | narrow.startswith("Sequence"))) | ((wide == "Numeric") & (narrow == "Bool")) | (wide == F.concat(F.lit("Optional<"), narrow, F.lit(">")))


def canonical(spelt: Column) -> Column:
    """A template's spelling without blanks that tell nothing apart: one between two words, none beside a mark."""
    return F.trim(F.regexp_replace(F.regexp_replace(spelt, r"\s+", " "), r"\s*([<>,*&]|::)\s*", "$1"))


def template_base(spelt: Column) -> Column:
    return F.regexp_extract(canonical(spelt), r"^[^<]*", 0)


def template_arguments(spelt: Column) -> Column:
    """Arguments of the outermost template, however deep they nest; none for a plain type."""
    inner = F.regexp_extract(canonical(spelt), r"^[^<]*<(.*)>$", 1)
    step = lambda a, c: F.struct(
        (a["depth"] + F.when(c == "<", 1).when(c == ">", -1).otherwise(0)).alias("depth"),
        F.concat(a["out"], F.when((c == ",") & (a["depth"] == 0), F.lit("\n")).otherwise(c)).alias("out"),
    )
    parts = F.aggregate(F.split(inner, ""), F.struct(F.lit(0).alias("depth"), F.lit("").alias("out")), step)["out"]
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(parts, "\n"))


def substituted(spelt: Column, of: Column) -> Column:
    """A type with the parameters that the map names replaced, all at once, wherever they stand."""
    tokens = F.regexp_extract_all(canonical(spelt), F.lit(r"[\w#]+|[^\w#]"), F.lit(0))
    return F.array_join(F.transform(tokens, lambda x: F.coalesce(F.try_element_at(of, x), x)), "")
