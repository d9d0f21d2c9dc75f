"""Tables of residues and edits, looked up by native map expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
#: Hydropathy, charge, volume and mass of residues.
RESIDUES = {
    "A": (1.8, 0, 88.6, 71.04),
    "R": (-4.5, 1, 173.4, 156.10),
    "N": (-3.5, 0, 114.1, 114.04),
    "D": (-3.5, -1, 111.1, 115.03),
    "C": (2.5, 0, 108.5, 103.01),
    "Q": (-3.5, 0, 143.8, 128.06),
    "E": (-3.5, -1, 138.4, 129.04),
    "G": (-0.4, 0, 60.1, 57.02),
    "H": (-3.2, 1, 153.2, 137.06),
    "I": (4.5, 0, 166.7, 113.08),
    "L": (3.8, 0, 166.7, 113.08),
    "K": (-3.9, 1, 168.6, 128.09),
    "M": (1.9, 0, 162.9, 131.04),
    "F": (2.8, 0, 189.9, 147.07),
    "P": (-1.6, 0, 112.7, 97.05),
    "S": (-0.8, 0, 89.0, 87.03),
    "T": (-0.7, 0, 116.1, 101.05),
    "W": (-0.9, 0, 227.8, 186.08),
    "Y": (-1.3, 0, 193.6, 163.06),
    "V": (4.2, 0, 140.0, 99.07),
}
#: The lower triangle of BLOSUM62, in its usual order of residues.
ORDER = "ARNDCQEGHILKMFPSTWYV"
BLOSUM62 = """
4
-1 5
-2 0 6
-2 -2 1 6
0 -3 -3 -3 9
-1 1 0 0 -3 5
-1 0 0 2 -4 2 5
0 -2 0 -1 -3 -2 -2 6
-2 0 1 -1 -3 0 0 -2 8
-1 -3 -3 -3 -1 -3 -3 -4 -3 4
-1 -2 -3 -4 -1 -2 -3 -4 -3 2 4
-1 2 0 -1 -3 1 1 -2 -1 -3 -2 5
-1 -1 -2 -3 -1 0 -2 -3 -2 1 2 -1 5
-2 -3 -3 -3 -2 -3 -3 -3 -1 0 0 -3 0 6
-1 -2 -2 -1 -3 -1 -1 -2 -2 -3 -3 -1 -2 -4 7
1 -1 1 0 -1 0 0 0 -1 -2 -2 0 -1 -2 -1 4
0 -1 0 -1 -1 -1 -1 -2 -2 -1 -1 -1 -1 -2 -1 1 5
-3 -3 -4 -4 -2 -2 -3 -2 -2 -3 -2 -3 -1 1 -4 -3 -2 11
-2 -2 -2 -3 -2 -1 -2 -3 2 -1 -1 -2 -1 3 -3 -2 -2 2 7
0 -3 -3 -3 -1 -2 -2 -3 -3 3 1 -2 1 -1 -2 -2 0 -3 -1 4
"""
#: What differences are divided by: score, hydropathy, charge, volume, mass.
SCALES = (11.0, 9.0, 2.0, 170.0, 130.0)
#: Names of edits.
EDIT_NAMES = {
    "[H]>>C": "methylation",
    "[H]>>CC": "ethylation",
    "[H]>>C(C)C": "isopropylation",
    "[H]>>C(C)(C)C": "tert-butylation",
    "C>>CC": "homologation_C1_to_C2",
    "CC>>CCC": "homologation_C2_to_C3",
    "C>>C(C)C": "branching_methyl_to_isopropyl",
    "[H]>>F": "fluorination",
    "[H]>>Cl": "chlorination",
    "[H]>>Br": "bromination",
    "[H]>>I": "iodination",
    "F>>Cl": "F_to_Cl_exchange",
    "Cl>>Br": "Cl_to_Br_exchange",
    "Br>>I": "Br_to_I_exchange",
    "F>>Br": "F_to_Br_exchange",
    "Cl>>F": "Cl_to_F_exchange",
    "O>>N": "OH_to_NH2",
    "N>>O": "NH2_to_OH",
    "O>>S": "O_to_S_bioisostere",
    "S>>O": "S_to_O_bioisostere",
    "C>>N": "aza_substitution",
    "N>>C": "deaza_substitution",
    "C>>O": "hydroxylation",
    "O>>[H]": "dehydroxylation",
    "C>>C(=O)": "carbonyl_formation",
    "C(=O)>>C": "carbonyl_reduction",
    "C(F)(F)F>>C": "CF3_removal",
    "C>>C(F)(F)F": "CF3_addition",
    "c1ccccc1>>c1ccncc1": "phenyl_to_pyridyl",
    "c1ccncc1>>c1ccccc1": "pyridyl_to_phenyl",
    "F>>[H]": "defluorination",
    "Cl>>[H]": "dechlorination",
    "Br>>[H]": "debromination",
    "I>>[H]": "deiodination",
}
#: Parts of a name and the category that they mean, first match first.
CATEGORIES = (
    ("methylation|ethylation", "alkylation"),
    ("homologation|branching", "chain_extension"),
    ("defluorination|dechlorination", "dehalogenation"),
    ("fluorination|chlorination", "halogenation"),
    ("exchange", "halogen_exchange"),
    ("bioisostere|to_pyridyl", "bioisosteric_replacement"),
    ("aza|deaza", "heteroatom_substitution"),
    ("OH_to|NH2_to", "functional_group_interconversion"),
)


def _lookup(table: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key)


def blosum62() -> dict[str, int]:
    """Scores by the two residues in alphabetical order of the pair's text."""
    rows = [line.split() for line in BLOSUM62.strip().splitlines()]
    return {x + y: int(rows[max(i, j)][min(i, j)]) for i, x in enumerate(ORDER) for j, y in enumerate(ORDER)}


def blosum_score(before: Column, after: Column) -> Column:
    """0 for pairs with an unknown residue."""
    return F.coalesce(_lookup(blosum62(), F.upper(F.concat(before, after))), F.lit(0))


def mutation_properties(before: Column, after: Column, scaled: bool = True) -> dict[str, Column]:
    """blosum, d_hydropathy, d_charge, d_volume, d_mass of a change; an unknown residue counts as 0."""
    by = SCALES if scaled else (1.0,) * 5
    out = {"blosum": blosum_score(before, after) / by[0]}
    for i, name in enumerate(("d_hydropathy", "d_charge", "d_volume", "d_mass")):
        column = {k: float(v[i]) for k, v in RESIDUES.items()}
        of = lambda c: F.coalesce(_lookup(column, F.upper(c)), F.lit(0.0))  # noqa: B023, E731
        out[name] = (of(after) - of(before)) / by[i + 1]
    return out


def edit_name(edit: Column) -> Column:
    """The name of an edit, or the edit itself."""
    return F.coalesce(_lookup(EDIT_NAMES, edit), edit)


def edit_category(edit: Column) -> Column:
    """The category of the edit's name."""
    name, out = edit_name(edit), None
    for pattern, category in CATEGORIES:
        out = (F if out is None else out).when(name.rlike(pattern), category)
    return out.otherwise("other")
