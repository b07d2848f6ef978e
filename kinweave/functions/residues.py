"""Residue alphabets, substitution diagonals and column functions over sequence strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The residue order, the two reduced alphabets, the diagonals of
# the public BLOSUM matrices in that order, their blend, the mask letter and the
# two shapes of protein accessions.
AA_ORDER = "ACDEFGHIKLMNPQRSTVWY"
ALPHABETS = {
    "murphy8": ["ILVM", "FYW", "STNQ", "KRH", "DE", "C", "GA", "P"],
    "murphy10": ["ILVM", "C", "FYW", "H", "KR", "DE", "NQ", "ST", "AG", "P"],
}
DIAGONALS = {
    "BLOSUM45": [5, 12, 7, 6, 8, 7, 10, 5, 5, 5, 6, 6, 9, 6, 7, 4, 5, 5, 15, 8],
    "BLOSUM62": [4, 9, 6, 5, 6, 6, 8, 4, 5, 4, 5, 6, 7, 5, 5, 4, 5, 4, 11, 7],
    "BLOSUM80": [5, 9, 6, 6, 6, 6, 8, 5, 5, 4, 6, 6, 8, 6, 6, 5, 5, 4, 11, 7],
}
BLEND = {"BLOSUM45": 0.20, "BLOSUM62": 0.60, "BLOSUM80": 0.20}
MASK = "X"
PIPED_ACCESSION = r"(?i)^(?:sp|tr)\|([A-Z][A-Z0-9]{5})\|"
BARE_ACCESSION = r"(?i)^([OPQ][0-9][A-Z0-9]{3}[0-9]|[A-NR-Z][0-9](?:[A-Z][A-Z0-9]{2}[0-9]){1,2})(?:\.\d+)?$"


def register_matrix(name: str, diagonal: list[int]) -> None:
    """Make another substitution matrix known by name; its diagonal goes by AA_ORDER."""
    if len(diagonal) != len(AA_ORDER):
        raise ValueError("a diagonal has one value for each residue")
    DIAGONALS[name] = list(diagonal)


def protein(text: Column) -> Column:
    """A text as a residue string: its letters in upper case without those that name no residue."""
    kept = AA_ORDER + MASK  # named one by one: a class of many ranges is slow to match
    return F.upper(F.regexp_replace(F.coalesce(text, F.lit("")), f"[^{kept}{kept.lower()}]+", ""))


def letters(seq: Column) -> Column:
    return F.when(F.length(seq) > 0, F.split(seq, "")).otherwise(F.array().cast("array<string>"))


def encode_residues(seq: Column) -> Column:
    """Place of each residue in AA_ORDER, -1 for masked and unknown ones."""
    return F.transform(letters(seq), lambda c: F.position(c, F.lit(AA_ORDER)) - 1)


def classes(alphabet: str) -> dict[str, int]:
    groups = ALPHABETS.get(alphabet, ALPHABETS["murphy8"])
    return {aa: k for k, group in enumerate(groups) for aa in group}


def encode_classes(seq: Column, alphabet: str = "murphy8") -> Column:
    """Reduced class of each residue, -1 for others; an unknown alphabet means murphy8."""
    return F.transform(encode_residues(reduced(seq, alphabet)), lambda k: k)


def reduced(seq: Column, alphabet: str = "murphy8") -> Column:
    """The sequence in a reduced alphabet: class k is written as AA_ORDER[k], whose weight it has."""
    of = classes(alphabet)
    return F.regexp_replace(F.translate(seq, AA_ORDER, "".join(AA_ORDER[of[aa]] for aa in AA_ORDER)), f"[^{AA_ORDER}]", MASK)


def diagonal(matrix: str) -> dict[str, int]:
    return dict(zip(AA_ORDER, DIAGONALS[matrix], strict=True))


def weight(residue: Column, matrix: str) -> Column:
    """Diagonal weight of a one-letter column; 0 for masked and unknown residues."""
    values = F.array(*[F.lit(v) for v in [0, *DIAGONALS[matrix]]])
    return F.element_at(values, F.position(residue, F.lit(AA_ORDER)) + 1)


def total_weight(seq: Column, matrix: str) -> Column:
    """Sum of the weights of a sequence."""
    return F.aggregate(letters(seq), F.lit(0).cast("long"), lambda a, c: a + weight(c, matrix))


def accession(seq_id: Column) -> Column:
    """The protein database accession in a sequence id, or null."""
    piped = F.regexp_extract(seq_id, PIPED_ACCESSION, 1)
    bare = F.regexp_extract(seq_id, BARE_ACCESSION, 1)
    return F.upper(F.coalesce(F.nullif(piped, F.lit("")), F.nullif(bare, F.lit(""))))
