"""Sequence functions as native column expressions; positions count from 0 unless said otherwise."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
KOZAK = {
    -6: {"G": 0.5, "A": 0.3, "C": 0.1, "U": 0.1},
    -5: {"C": 0.5, "G": 0.2, "A": 0.2, "U": 0.1},
    -4: {"C": 0.5, "A": 0.2, "G": 0.2, "U": 0.1},
    -3: {"A": 0.5, "G": 0.4, "C": 0.05, "U": 0.05},
    -2: {"C": 0.4, "A": 0.2, "G": 0.2, "U": 0.2},
    -1: {"C": 0.4, "A": 0.2, "G": 0.2, "U": 0.2},
    4: {"G": 0.5, "A": 0.2, "C": 0.2, "U": 0.1},
}
BASES = "UCAG"
AMINO = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
REGIONS = ((26, "FR1"), (38, "CDR1"), (55, "FR2"), (65, "CDR2"), (104, "FR3"), (117, "CDR3"), (128, "FR4"))
ARE = {"class_I": "AUUUA", "class_II": "AUUUAUUUA", "class_III": "U{5,}"}


def char(s: Column, i: Column | int) -> Column:
    """The character at a 0-based place."""
    return s.substr((i if isinstance(i, Column) else F.lit(i)) + 1, F.lit(1))


def places(n: Column, step: int = 1) -> Column:
    """0, step, 2 step, ... below n; empty for n < 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is worked out once, however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def sql_round(x: Column, digits: int) -> Column:
    """A double rounded as SQL does: x times 10**digits to the nearest whole number, halves away from zero; zero keeps its sign.

    round() goes by decimal digits instead, which differs where the product is no exact half (0.5077685).
    """
    scale = 10.0**digits
    y = F.abs(x) * scale
    return F.signum(x) * (F.rint(y) + F.when(y - F.rint(y) == 0.5, 1.0).otherwise(0.0)) / scale  # rint takes halves to even numbers


def seq_validate(s: Column, unknown: bool = False) -> Column:
    return F.upper(s).rlike("^[ACGUTN]*$" if unknown else "^[ACGUT]*$")


def to_rna(s: Column) -> Column:
    return F.translate(F.upper(s), "T", "U")


def to_dna(s: Column) -> Column:
    return F.translate(F.upper(s), "U", "T")


def reverse_complement(s: Column) -> Column:
    """Of an RNA sequence; whatever is no base becomes N."""
    return F.reverse(F.translate(F.regexp_replace(to_rna(s), "[^ACGU]", "N"), "ACGU", "UGCA"))


def gc_content(s: Column, empty: float = 0.0) -> Column:
    return F.when(F.length(s) > 0, F.regexp_count(s, F.lit("[GC]")) / F.length(s)).otherwise(F.lit(empty))


def mismatches(a: Column, b: Column) -> Column:
    """Places where two sequences differ, up to the shorter length."""
    return let(a, lambda x: let(b, lambda y: F.filter(places(F.least(F.length(x), F.length(y))), lambda i: char(x, i) != char(y, i))))


def hamming_distance(a: Column, b: Column) -> Column:
    """-1 for unequal lengths."""
    return F.when(F.length(a) == F.length(b), F.size(mismatches(a, b))).otherwise(F.lit(-1))


def first_difference(a: Column, b: Column) -> Column:
    """Null where one is a prefix of the other."""
    return F.get(mismatches(a, b), F.lit(0))


def extract_edit(a: Column, b: Column, context: int = 10) -> Column:
    """struct(kind, position, from, to, size, upstream, downstream) of the edit that makes b of a.

    none; SNV; complex (several mismatches: all from the first to the last one); insertion or deletion of the surplus
    at the first difference, or at the end of the shorter one.
    """
    la, lb = F.length(a), F.length(b)

    def of(m: Column, at: Column) -> Column:
        last = F.try_element_at(m, F.lit(-1))
        kind = F.when(a == b, "none").when(la < lb, "insertion").when(la > lb, "deletion").when(F.size(m) == 1, "SNV").otherwise("complex")
        span = F.when(la == lb, F.coalesce(last - at + 1, F.lit(0)))
        before = F.when(la == lb, a.substr(at + 1, span)).when(la > lb, a.substr(at + 1, la - lb)).otherwise("")
        after = F.when(la == lb, b.substr(at + 1, span)).when(la < lb, b.substr(at + 1, lb - la)).otherwise("")
        size = F.when(la == lb, F.size(m)).otherwise(F.abs(la - lb))
        up = F.greatest(F.lit(0), at - context)
        return F.struct(kind.alias("kind"), at.alias("position"), before.alias("from"), after.alias("to"), size.alias("size"), a.substr(up + 1, at - up).alias("upstream"), a.substr(at + F.length(before) + 1, F.lit(context)).alias("downstream"))

    return let(mismatches(a, b), lambda m: let(F.coalesce(F.get(m, F.lit(0)), F.least(la, lb)), lambda at: of(m, at)))


def all_differences(a: Column, b: Column) -> Column:
    """array<struct(position, from, to)> of sequences of equal length."""
    return F.transform(mismatches(a, b), lambda i: F.struct(i.alias("position"), char(a, i).alias("from"), char(b, i).alias("to")))


def describe_differences(d: Column) -> Column:
    return F.array_join(F.transform(d, lambda x: F.concat(x.position.cast("string"), F.lit(":"), x["from"], F.lit(">"), x.to)), "|")


def change_class(before: Column, after: Column) -> Column:
    """transition, transversion or other."""
    two = F.concat(before, after)
    return F.when(two.isin("AG", "GA", "CU", "UC"), "transition").when((F.length(two) == 2) & (before != after), "transversion").otherwise("other")


def find_all(s: Column, motif: str) -> Column:
    """Places of a motif, overlapping ones too."""
    return let(s, lambda x: F.filter(places(F.length(x) - (len(motif) - 1)), lambda i: x.substr(i + 1, F.lit(len(motif))) == motif))


def kozak_score(s: Column) -> Column:
    """The largest weight sum around any AUG over the largest possible sum; 0 without one. Outside the sequence counts 0."""
    best = sum(max(w.values()) for w in KOZAK.values())

    def at(i: Column) -> Column:
        total = F.lit(0.0)
        for offset, weights in KOZAK.items():
            c = F.when(i + offset >= 0, char(s, i + offset)).otherwise("")
            one = F.lit(0.0)
            for base, w in weights.items():
                one = F.when(c == base, w).otherwise(one)
            total = total + one
        return total / best

    return F.coalesce(F.array_max(F.transform(find_all(s, "AUG"), at)), F.lit(0.0))


def motif_flags(s: Column, gc_share: float = 0.6) -> Column:
    """struct of booleans; an upstream AUG is one that is not the last.

    kozak: an AUG three places after A or G, with four more bases behind it, or the consensus; au_rich: AUUUA (which the
    longer element holds too); gc_rich: at least `gc_share` of G and C.
    """
    augs = find_all(s, "AUG")
    return F.struct(s.rlike("[AG]CCAUGG|[AG]..AUG.{4}").alias("kozak"), (F.size(augs) > 1).alias("uaug"), s.rlike("AUG(?:[ACGU]{3})*?(?:UAA|UAG|UGA)").alias("uorf"), s.rlike("AUUUA").alias("au_rich"), (gc_content(s) >= gc_share).alias("gc_rich"))


def kmer_shares(seq: Column, k: int) -> Column:
    """array of (kmer, share): each k-mer of A, C, G, U and its share of all of them.

    The k-mers of a row are sorted; where one ends in that order, the distance to the end before it is its count.
    """
    mers = F.filter(F.transform(places(F.length(seq) - (k - 1)), lambda i: seq.substr(i + 1, F.lit(k))), lambda m: m.rlike("^[ACGU]+$"))

    def counted(m: Column) -> Column:
        ends = F.filter(places(F.size(m)), lambda i: F.get(m, i) != F.coalesce(F.get(m, i + 1), F.lit("")))
        shares = lambda e: F.transform(e, lambda end, at: F.struct(F.get(m, end).alias("kmer"), ((end - F.coalesce(F.get(e, at - 1), F.lit(-1))) / F.size(m)).alias("share")))
        return let(ends, shares)

    return let(F.sort_array(mers), counted)


def edit_vector(a: Column, b: Column) -> Column:
    """array of 9: SNV, insertion, deletion, complex; relative place; log1p(size) / 5; change of the best Kozak score; sign of the change in AUGs; change of GC."""
    augs = F.size(find_all(b, "AUG")) - F.size(find_all(a, "AUG"))

    def of(e: Column) -> Column:
        known = [e.kind == "SNV", e.kind == "insertion", e.kind == "deletion", ~e.kind.isin("SNV", "insertion", "deletion")]
        return F.array(*(k.cast("double") for k in known), e.position / F.greatest(F.length(a), F.length(b), F.lit(1)), F.log1p(e.size) / 5, kozak_score(b) - kozak_score(a), F.signum(augs.cast("double")), gc_content(b) - gc_content(a))

    return let(extract_edit(a, b), of)


#: Changes of one base into another, M being a methylated A.
CHANGES = ("AC", "AG", "AU", "AM", "CA", "CG", "CU", "GA", "GC", "GU", "UA", "UC", "UG", "MA")
PAIR_TYPES = ("A_vs_A", "M_vs_M", "M_vs_A")


def edit_onehot(position: Column, before: Column, after: Column, pair_type: Column, places_: int = 7) -> Column:
    """array of ints: one-hot of the place (the last one for places beyond), of the change and of the pair type."""
    at = F.least(position, F.lit(places_ - 1))
    change = F.translate(F.upper(F.concat(before, after)), "T", "U")
    flags = [at == i for i in range(places_)] + [change == c for c in CHANGES] + [pair_type == p for p in PAIR_TYPES]
    return F.array(*(F.coalesce(f, F.lit(False)).cast("int") for f in flags))


def edit_signature(a: Column, b: Column, bins: int = 3) -> Column:
    """Kind of edit, its part of the longer sequence and the class of its first change, as one text.

    Sequences of unlike length count from place 0 and are indels; equal ones are identical.
    """
    la, lb = F.length(a), F.length(b)

    def of(m: Column) -> Column:
        n, at = F.size(m), F.coalesce(F.get(m, F.lit(0)), F.lit(0))
        kind = F.when(la < lb, "insertion").when(la > lb, "deletion").when(n == 0, "identical").when(n == 1, "snv").otherwise("multiple_snv")
        part = F.when((la == lb) & (n > 0), F.least(F.floor(at * bins / F.greatest(la, lb, F.lit(1))), F.lit(bins - 1))).otherwise(0)
        transition = F.concat(char(a, at), char(b, at)).isin("AG", "GA", "CU", "UC")
        change = F.when(la != lb, "indel").when(n == 0, "none").when(transition, "transition").otherwise("transversion")
        return F.concat_ws("|", kind, part.cast("string"), change)

    return let(mismatches(a, b), of)


def find_uorfs(s: Column, least: int = 9) -> Column:
    """array<struct(start, end, length)>: each AUG with its first stop in frame, `least` long with the stop."""

    def stop(i: Column) -> Column:
        frame = F.when(F.length(s) >= i + 6, F.sequence(i + 3, F.length(s) - 3, F.lit(3))).otherwise(F.array().cast("array<int>"))
        return F.get(F.filter(frame, lambda j: s.substr(j + 1, F.lit(3)).isin("UAA", "UAG", "UGA")), F.lit(0))

    stops = F.transform(find_all(s, "AUG"), lambda i: F.struct(i.alias("start"), (stop(i) + 3).alias("end")))
    found = F.filter(stops, lambda o: o.end - o.start >= least)
    return F.transform(found, lambda o: F.struct(o.start.alias("start"), o.end.alias("end"), (o.end - o.start).alias("length")))


def find_are_motifs(s: Column) -> Column:
    """array<struct(kind, position, motif)>: matches of each class that do not overlap, from the left."""

    def of(kind: str, pattern: str) -> Column:
        hits = F.regexp_extract_all(s, F.lit(f"({pattern})"), F.lit(1))
        gaps = F.split(s, pattern, -1)
        return F.transform(hits, lambda h, i: F.struct(F.lit(kind).alias("kind"), F.length(F.concat(F.array_join(F.slice(gaps, F.lit(1), i + 1), ""), F.array_join(F.slice(hits, F.lit(1), i), ""))).alias("position"), h.alias("motif")))

    return F.concat(*(of(k, p) for k, p in ARE.items()))


def cap_accessibility(s: Column, width: int = 30) -> Column:
    """1 - (GC + share of 4-mers whose reverse complement also occurs) / 2 of the first `width` bases, within 0 and 1."""
    head = F.substring(s, 1, width)
    mers = F.transform(places(F.length(head) - 3), lambda i: head.substr(i + 1, F.lit(4)))
    paired = F.size(F.filter(mers, lambda m: F.contains(head, F.reverse(F.translate(m, "ACGU", "UGCA")))))
    share = F.coalesce(F.try_divide(paired, F.size(mers)), F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - (0.5 * gc_content(head) + 0.5 * share)))


def codon_table() -> Column:
    """Codon -> residue, from the order of the bases."""
    pairs = [F.lit(x) for i, a in enumerate(BASES) for j, b in enumerate(BASES) for k, c in enumerate(BASES) for x in (a + b + c, AMINO[16 * i + 4 * j + k])]
    return F.create_map(*pairs)


def translate_codons(s: Column, frame: int = 0) -> Column:
    """Residues up to the first stop; unknown codons are X."""
    whole = F.filter(places(F.length(s) - frame - 2, 3), lambda i: F.length(s) >= i + frame + 3)
    residues = F.array_join(F.transform(whole, lambda i: F.coalesce(F.try_element_at(codon_table(), s.substr(i + frame + 1, F.lit(3))), F.lit("X"))), "")
    return F.substring_index(residues, "*", 1)


def is_drach(loop: Column) -> Column:
    """Seven bases around a methylated A, M read as A."""
    return F.translate(loop, "M", "A").rlike("^.[AGU][AG]AC[ACU].$")


def parse_mutation(text: Column) -> Column:
    """struct(chain, from, position, to) of A50G, H:A50G, HA50G or AH50G; 0-based position; null if it is none of these."""
    colon = "^([HL]):([A-Z])([0-9]+)([A-Z])$"
    plain, front, inner = "^([A-Z])([0-9]+)([A-Z])$", "^([HL])([A-Z])([0-9]+)([A-Z])$", "^([A-Z])([HL])([0-9]+)([A-Z])$"
    g = lambda p, i: F.regexp_extract(text, p, i)

    def made(chain, before, number, after):
        return F.struct(chain.alias("chain"), before.alias("from"), (number.cast("int") - 1).alias("position"), after.alias("to"))

    return (
        F.when(text.rlike(colon), made(g(colon, 1), g(colon, 2), F.nullif(g(colon, 3), F.lit("")), g(colon, 4)))
        .when(text.rlike(plain), made(F.lit("H"), g(plain, 1), F.nullif(g(plain, 2), F.lit("")), g(plain, 3)))
        .when(text.rlike(front), made(g(front, 1), g(front, 2), F.nullif(g(front, 3), F.lit("")), g(front, 4)))
        .when(text.rlike(inner), made(g(inner, 2), g(inner, 1), F.nullif(g(inner, 3), F.lit("")), g(inner, 4)))
    )


def apply_mutations(wild: Column, mutations: Column) -> Column:
    """The sequence after all mutations (struct with position and to), in order; those outside it change nothing."""
    return F.aggregate(mutations, wild, lambda s, m: F.when((m.position >= 0) & (m.position < F.length(s)), F.overlay(s, m.to, m.position + 1, F.lit(1))).otherwise(s))


def region_label(position: Column) -> Column:
    """Region of a 1-based position."""
    out = F.when(position < 1, None)
    for end, name in REGIONS:
        out = out.when(position <= end, name)
    return out


def index_array(text: Column) -> Column:
    """`1;2;3` -> array<int>; bad items are skipped."""
    return F.filter(F.transform(F.split(text, ";"), lambda x: x.try_cast("int")), lambda x: x.isNotNull())


def index_pairs(text: Column) -> Column:
    """`0,0;1,1` -> array<struct(a, b)>; bad pairs are skipped."""
    parts = F.filter(F.split(text, ";"), lambda x: x.rlike("^-?[0-9]+,-?[0-9]+$"))
    return F.transform(parts, lambda x: F.struct(F.substring_index(x, ",", 1).cast("int").alias("a"), F.substring_index(x, ",", -1).cast("int").alias("b")))


def parse_edit(text: Column) -> Column:
    """`a>>b` -> struct(from, to); null if it is no edit."""
    parts = F.split(text, ">>")
    return F.when(F.size(parts) == 2, F.struct(F.get(parts, F.lit(0)).alias("from"), F.get(parts, F.lit(1)).alias("to")))


def site_features(s: Column, centre: Column, widths: tuple[int, ...], digits: int = 6) -> dict[str, Column]:
    """Features around a 0-based place by name: shares in the whole sequence and within `widths`, neighbours, shares of neighbouring pairs."""
    n, r = F.length(s), lambda c: sql_round(c, digits)
    share = lambda w, p: r(F.coalesce(F.try_divide(F.regexp_count(w, F.lit(f"[{p}]")), F.length(w)), F.lit(0.0)))
    out = {f"global_{b.lower()}": share(s, b) for b in "ACGU"} | {"global_gc": share(s, "GC"), "global_purine": share(s, "AG")}
    for w in widths:
        first = F.greatest(F.lit(0), centre - w)
        window = s.substr(first + 1, F.least(n, centre + w + 1) - first)
        out |= {f"{b.lower()}_{w}": share(window, b) for b in ("A", "C", "G", "U", "GC")}
    out |= {f"left_{b.lower()}": F.when((centre > 0) & (char(s, centre - 1) == b), 1).otherwise(0) for b in "ACGU"}
    out |= {f"right_{b.lower()}": F.when(char(s, centre + 1) == b, 1).otherwise(0) for b in "ACGU"}
    for pair in (a + b for a in "ACGU" for b in "ACGU"):
        # matches by lookahead may overlap
        out[f"pair_{pair.lower()}"] = r(F.regexp_count(s, F.lit(f"{pair[0]}(?={pair[1]})")) / F.greatest(n - 1, F.lit(1)))
    return out


def design_matrix(rows: DataFrame, families: list[DataFrame], key: str) -> DataFrame:
    """(key, features): numeric columns of `rows` and of feature families joined by key, in the order of their names, gaps as 0."""
    for family in families:
        rows = rows.join(family, key, "left")
    names = sorted(c for c in rows.columns if c != key)
    return rows.select(key, F.array(*(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in names)).alias("features"))
