"""Names: normal forms, variants, parts, similarity. Plain column functions; nearly every join is on one of these."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from pathloom.functions import vocab


def _words(*xs: str) -> Column:
    return F.array(*map(F.lit, xs))


def canonical(c: Column) -> Column:
    """Trimmed, runs of white space as one blank."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def fold(c: Column) -> Column:
    """Lower case for comparison."""
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def _unless(c: Column, form: str, made: Column) -> Column:
    """Most names are their own normal form, which one look tells."""
    return F.when(c.rlike(form), c).otherwise(made)


def norm_with_colon(c: Column) -> Column:
    return _unless(c, r"^[a-z0-9:]++(?: [a-z0-9:]++)*+\z", F.regexp_replace(fold(canonical(c)), "[^a-z0-9: ]+", ""))


def norm(c: Column) -> Column:
    return _unless(c, r"^[a-z0-9]++(?: [a-z0-9]++)*+\z", F.regexp_replace(fold(canonical(c)), "[^a-z0-9 ]+", ""))


def graph_id(c: Column) -> Column:
    return F.lower(canonical(c))


def squeezed(c: Column) -> Column:
    """Letters and digits only."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def plain(c: Column) -> Column:
    """Dashes and no-break blanks as ASCII, canonical."""
    return canonical(F.translate(c, "–—− ", "--- "))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def distinct_by(values: Column, key: Callable[[Column], Column] = norm, limit: int | None = None) -> Column:
    """The first of each key, in order, those without a key left out. Each key is made once and the keys are sorted, so a long
    list is no quadratic one."""
    keyed = F.filter(F.transform(values, lambda x, i: F.struct(key(x).alias("k"), i.alias("i"), x.alias("x"))), lambda y: y["k"] != "")
    firsts = lambda s: F.zip_with(s, F.concat(F.slice(s, 1, 0), F.array(F.lit(None)), s), lambda y, before: F.when(y["k"].isNotNull() & ~y["k"].eqNullSafe(before["k"]), F.struct(y["i"].alias("i"), y["x"].alias("x"))))
    kept = F.transform(F.sort_array(F.array_compact(bound(F.sort_array(keyed), firsts))), lambda y: y["x"])
    return F.slice(kept, 1, limit) if limit else kept


def tokens(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(norm(c), " "), lambda x: x != ""))


def punctuated_tokens(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.regexp_replace(fold(c), "[^a-z0-9]+", " "), " "), lambda x: x != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Of two token arrays: 1 if both are empty, 0 if one is."""
    either = F.size(F.array_union(a, b))
    return F.when(either == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / either)


def name_score(a: Column, b: Column) -> Column:
    return F.when(norm(a) == norm(b), 0.95).otherwise(0.35 + 0.6 * jaccard(tokens(a), tokens(b)))


def _found(base: Column, forms: Callable[[Column], Column]) -> Column:
    """Forms of a name, or the name if it has none."""
    either = lambda b: bound(forms(b), lambda f: F.when(F.size(f) > 0, f).when(b != "", F.array(b)).otherwise(F.array().cast("array<string>")))
    return bound(base, either)


def variants(c: Column, limit: int = 4) -> Column:
    """A name, without parentheses, with separators as blanks, without 'protein' and 'enzyme'."""
    forms = lambda b: F.array(b, F.regexp_replace(b, r"\([^)]*\)", " "), F.regexp_replace(b, "[/,;:_-]", " "), F.regexp_replace(b, r"(?i)\b(protein|enzyme)\b", " "))
    return _found(plain(c), lambda b: distinct_by(F.transform(forms(b), canonical), norm, limit))


def search_terms(c: Column, limit: int = 6) -> Column:
    """Six forms of a name to search by."""
    forms = lambda b: F.array(b, F.regexp_replace(b, "[+/]", " "), F.regexp_replace(b, "[-_]", " "), F.regexp_replace(b, "[^A-Za-z0-9 ]+", " "), norm(b), F.replace(norm(b), F.lit(" "), F.lit("")))
    return _found(plain(c), lambda b: distinct_by(F.filter(F.transform(forms(b), canonical), lambda x: F.length(x) >= 2), norm, limit))


def composite_parts(c: Column, conjunction: bool = True) -> Column:
    """Parts around ``+`` (and ``and``)."""
    pattern = r"(?i)\s*\+\s*|\s+and\s+" if conjunction else r"\s*\+\s*"
    return F.filter(F.transform(F.split(c, pattern), canonical), lambda x: x != "")


def complex_parts(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, ":"), canonical), lambda x: x != "")


def complex_name(c: Column) -> Column:
    parts = complex_parts(c)
    return F.when(F.size(parts) >= 2, F.array_join(parts, ":")).otherwise(canonical(c))


def modifier_name(c: Column) -> Column:
    text = canonical(F.replace(c, F.lit("_"), F.lit(" ")))
    return canonical(F.regexp_replace(text, r"(?i) complex$", ""))


def repeated_part(c: Column) -> Column:
    """``2 X`` as X, X; at most eight."""
    n = F.least(F.greatest(F.regexp_extract(c, r"^\s*(\d+)\s+(.+)$", 1).try_cast("int"), F.lit(1)), F.lit(8))
    base = F.trim(F.regexp_extract(c, r"^\s*(\d+)\s+(.+)$", 2))
    return F.when(base != "", F.array_repeat(base, F.coalesce(n, F.lit(8)))).otherwise(F.array(F.trim(c)))


def equation_side(c: Column, left: bool) -> Column:
    """The parts of one side of an equation within a name, a label before a colon cut off the left one."""
    arrow = F.regexp_instr(c, F.lit("->|→"))
    side = F.trim(F.regexp_extract(c, r"^(.*?)(?:->|→)", 1)) if left else F.trim(F.regexp_extract(c, r"^.*?(?:->|→)(.*)$", 1))
    if left:
        side = F.trim(F.regexp_replace(side, r"^[^:]*:", ""))
    return F.when(arrow > 0, F.flatten(F.transform(composite_parts(side), repeated_part))).otherwise(F.array().cast("array<string>"))


def has_plus(c: Column) -> Column:
    """A ``+`` that is no charge at the end."""
    return F.contains(F.regexp_replace(F.rtrim(F.regexp_replace(F.rtrim(canonical(c)), r"\+$", "")), r"\d+\+$", ""), F.lit("+"))


def is_byproduct(c: Column) -> Column:
    t = fold(canonical(c))
    return t.isin(*vocab.BYPRODUCTS) | t.endswith(vocab.BYPRODUCT_SUFFIX)


def looks_like_protein(c: Column) -> Column:
    return c.rlike("(?i)" + vocab.PROTEIN_LIKE)


def model_species_is_protein(sid: Column, name: Column) -> Column:
    return F.coalesce(F.lower(F.trim(sid)).startswith("p_"), F.lit(False)) | F.coalesce(F.lower(name).rlike("|".join(vocab.MODEL_PROTEIN_HINTS)), F.lit(False))


def is_generic_class(c: Column) -> Column:
    return F.lower(c).rlike("|".join(vocab.GENERIC_CLASSES))


def is_binomial(c: Column) -> Column:
    return c.rlike(vocab.BINOMIAL)


def modifier_role(relationship: Column) -> Column:
    has = lambda p: relationship.rlike("(?i)" + p)
    activates = has(vocab.CATALYTIC) & has("(activat|promot|stimulat)") & ~has("(catalyz|catalys|enzyme)")
    return F.when(has(vocab.INHIBITING), "inhibitor").when(has(vocab.TRANSPORTING), "transporter").when(activates, "activator").otherwise("catalyst")


def route(name: Column, hint: Column, known_protein: Column) -> Column:
    """What a name is looked up as, and why."""
    base, h = plain(name), F.lower(plain(F.coalesce(hint, F.lit(""))))
    pair = lambda r, why: F.struct(F.lit(r).alias("route"), F.lit(why).alias("reason"))
    return (
        F.when(F.contains(base, F.lit(":")) | h.isin("complex", "protein_complex"), pair("complex", "complex_entity"))
        .when(h.isin("protein", "enzyme", "modifier"), pair("protein", "type_hint"))
        .when(F.coalesce(known_protein, F.lit(False)), pair("protein", "known_protein_like"))
        .when(looks_like_protein(base), pair("protein", "name_pattern"))
        .otherwise(pair("compound", "default_compound_route"))
    )


def chebi_id(c: Column) -> Column:
    t = F.upper(canonical(c))
    digits = F.regexp_replace(t, "[^0-9]", "")
    return F.when(t.startswith("CHEBI:"), t).when(t.startswith("CHEBI") & (digits != ""), F.concat(F.lit("CHEBI:"), digits)).when(t.rlike("^[0-9]+$"), F.concat(F.lit("CHEBI:"), t)).otherwise(t)


def kegg_id(c: Column) -> Column:
    return F.replace(F.upper(canonical(c)), F.lit("CPD:"), F.lit(""))


def hmdb_id(c: Column) -> Column:
    """With seven digits where the digits are fewer."""
    t = F.upper(canonical(c))
    digits = F.regexp_replace(t, "[^0-9]", "")
    return F.when(digits == "", t).otherwise(F.concat(F.lit("HMDB"), F.when(F.length(digits) < 7, F.lpad(digits, 7, "0")).otherwise(digits)))


def doi(text: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(F.substring(text, 1, 2000), r"\b(10\.\d{4,}/[^\s\"'<>]+)", 1), r"[.,;)]+$", "")


def search_tokens(text: Column) -> Column:
    """Words of a text without stop words, in order."""
    return F.filter(F.regexp_extract_all(fold(text), F.lit("[a-z0-9]+"), F.lit(0)), lambda x: ~x.isin(*vocab.STOP_WORDS))


def synonyms(text: Column, commas: bool = False, limit: int = 64) -> Column:
    return distinct_by(F.transform(F.split(text, "[;|,]" if commas else "[;|]"), plain), norm, limit)


def stoichiometry_key(value: Column) -> Column:
    r = F.round(value, 8)
    return F.when(F.abs(r - F.round(r)) < 1e-9, F.round(r).cast("long").cast("string")).otherwise(F.regexp_replace(F.format_string("%.8g", r), r"\.?0+$", ""))


def model_id(c: Column) -> Column:
    """An identifier of letters, digits and underscores that doesn't begin with a digit."""
    t = F.regexp_replace(F.trim(c), "[^A-Za-z0-9_]", "_")
    return F.when(t == "", "id").when(t.rlike("^[0-9]"), F.concat(F.lit("_"), t)).otherwise(t)


def short_hash(c: Column, n: int = 8) -> Column:
    return F.substring(F.sha1(c), 1, n)


def reaction_label(inputs: Column, outputs: Column) -> Column:
    side = lambda a: F.when(F.size(a) > 0, F.array_join(a, " + ")).otherwise("?")
    return F.concat(side(inputs), F.lit(" → "), side(outputs))


def pointer(*parts: Column) -> Column:
    """A JSON pointer."""
    return F.concat(F.lit("/"), F.concat_ws("/", *[F.replace(F.replace(p.cast("string"), F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1")) for p in parts]))


def pointer_parts(c: Column) -> Column:
    return F.transform(F.filter(F.split(c, "/"), lambda x, i: i > 0), lambda x: F.replace(F.replace(x, F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~")))


def same_names(a: Column, b: Column) -> Column:
    """Whether two lists hold the same names, as often."""
    return F.array_sort(F.transform(a, norm)) == F.array_sort(F.transform(b, norm))


def alias(c: Column) -> Column:
    """A known synonym's standard name, or the name."""
    table = F.create_map(*[F.lit(x) for kv in vocab.ALIASES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, fold(canonical(c))), canonical(c))


def compartment(c: Column) -> Column:
    """The vocabulary's name of a place: itself, an alias, or the longest term that it contains; else ''."""
    t = F.lower(F.trim(c))
    table = F.create_map(*[F.lit(x) for kv in vocab.COMPARTMENT_ALIASES.items() for x in kv])
    out = F.when(t.isin(*vocab.COMPARTMENTS), t).when(F.try_element_at(table, t).isNotNull(), F.try_element_at(table, t))
    for term in sorted(vocab.COMPARTMENTS, key=lambda x: (-len(x), x)):
        out = out.when(F.contains(t, F.lit(term)), term)
    return out.otherwise("")


def bound_evidence(left: Column, right: Column, evidence: Column) -> Column:
    """Whether a text says that two names are bound: ``exact`` as a composite, ``phrase`` in words."""
    low = lambda c: F.lower(F.translate(c, "Σ", "σ"))
    q = lambda c: F.concat(F.lit("\\Q"), c, F.lit("\\E"))

    def told(v: Column) -> Column:
        says = lambda mid, end="": F.regexp_like(v["e"], F.concat(F.lit("(?i)"), q(v["l"]), F.lit(mid), q(v["r"]), F.lit(end)))
        # a pattern is made for each row, so only for texts that hold both names
        both = (v["e"] != "") & F.contains(low(v["e"]), low(v["l"])) & F.contains(low(v["e"]), low(v["r"]))
        return F.struct((both & says(r"\s*\+\s*")).alias("exact"), (both & (says(r"\s+bound\s+to\s+") | says(r"\s*-\s*", r"\s+complex") | says(r"\s+conjugated\s+to\s+"))).alias("phrase"))

    return bound(F.struct(canonical(left).alias("l"), canonical(right).alias("r"), canonical(evidence).alias("e")), told)


def moved_name(name: Column, source: Column, target: Column) -> Column:
    """A transport's name with the places after ``from`` and ``to`` replaced by the given ones."""
    return F.when(name.rlike(r"(?i)\bfrom\s+(.+?)\s+to\s+(.+)$"), F.concat(F.regexp_replace(name, r"(?i)\bfrom\s+.+?\s+to\s+.+$", ""), F.lit("from "), source, F.lit(" to "), target)).otherwise(name)


def section_relevance(label: Column) -> Column:
    name = F.lower(F.trim(label))
    out = F.when(F.lit(False), F.lit(0.0))
    for k, v in vocab.SECTION_RELEVANCE.items():
        out = out.when(name == k, v)
    for k, v in vocab.SECTION_RELEVANCE.items():
        out = out.when(F.contains(name, F.lit(k)), v)
    return out.otherwise(vocab.OTHER_SECTION_RELEVANCE)
