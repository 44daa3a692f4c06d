"""Word lists and patterns that results depend on, and the means to replace them.

The lists below are fixed values: they have to be these for the results to be these. A taxonomy file replaces the
keyword lists; a thesaurus is always a parameter.
"""

from __future__ import annotations

import json
from pathlib import Path

# Fixed values.
BM25_STOP_WORDS = "le la de des et ou est un une à au en dans pour par sur avec sans ce cette ces".split()
KEYWORD_STOP_WORDS = (
    "le la de des et ou est un une à au en dans pour par sur avec sans ce cette ces mon ma mes ton ta tes "
    "son sa ses notre nos votre vos leur leurs comment où quand pourquoi qui quoi"
).split()
OVERLAP_STOP_WORDS = (
    "le la les un une des de du au aux ce cette ces mon ma mes ton ta tes son sa ses notre nos votre vos leur leurs "
    "je tu il elle on nous vous ils elles et ou mais donc car ni que qui quoi pour par avec sans sur sous dans entre "
    "est sont être avoir fait faire"
).split()
TAXONOMY = {
    "gds": ["gds", "galileo", "sabre", "amadeus", "bsp", "pnr", "billet", "emission", "emettre", "reemettre", "void"],
    "specific": ["couleur", "robot", "conge", "gds", "galileo", "sabre", "bsp", "whaller", "tarif", "emission", "regle", "procedure", "etape", "format", "code", "train", "lowcost", "sncf"],
    "vague": ["que faire", "probleme", "echec", "erreur", "impossible"],
    "broad": ["comment", "procedure", "process", "etapes", "resume", "explique", "guide", "que faire"],
}
RERANK_VAGUE_WORDS = ["comment", "que faire", "quels", "quelles", "quel"]
CLAIM_PATTERNS = [
    r"(?:^|[^\p{L}\p{N}_])(est|sont|était|étaient|sera|seront|serait|seraient)(?:$|[^\p{L}\p{N}_])",
    r"(?:^|[^\p{L}\p{N}_])(a|ont|avait|avaient|aura|auront|aurait|auraient)(?:$|[^\p{L}\p{N}_])",
    r"(?:^|[^\p{L}\p{N}_])(peut|peuvent|doit|doivent|faut|veut|veulent)(?:$|[^\p{L}\p{N}_])",
    r"(?:^|[^\p{L}\p{N}_])(existe|comprend|contient|inclut|nécessite|permet|requiert)(?:$|[^\p{L}\p{N}_])",
    r"(?:^|[^\p{L}\p{N}_])(faire|émettre|annuler|modifier|consulter|envoyer|traiter)(?:$|[^\p{L}\p{N}_])",
    r"^\s*\d+",
    r":\s*\S",
]
#: Claims as the verifier by embeddings knows them.
EMBEDDING_CLAIM_PATTERNS = [
    r"(?:^|[^\p{L}\p{N}_])(est|sont|avoir|être|pouvoir|devoir|vouloir)(?:$|[^\p{L}\p{N}_])",
    r"(?:^|[^\p{L}\p{N}_])(existe|occupe|comprend|contient)(?:$|[^\p{L}\p{N}_])",
    r"^\d+",
]
COMMON_NUMBERS = [str(n) for n in range(25)] + ["30", "60", "90", "100", "1000", "2024", "2025", "2026"]
REDIRECT_MARKERS = ("Whaller", "Consulter")
PROCESS_MARKERS = ("Process", "Étape", "Procédure", "Etape")
AUTO_CATEGORIES = {"amadeus_formats": ("amadeus", "gds", "format"), "absences": ("congé", "absence"), "gds_operations": ("émission", "dossier")}

#: A small thesaurus for tests and demonstration; real ones are loaded.
SAMPLE_THESAURUS = {"train": ["rail", "locomotive"], "guide": ["manuel", "notice"], "that": ["which"], "with": ["alongside", "together"], "für": ["wegen"]}


def load_thesaurus(path: str | None) -> dict[str, list[str]]:
    """Terms and their alternatives from a JSON file: an object of lists, or a list of [term, alternative] pairs; the sample without a path.

    A thesaurus is data of an installation; a file that can't be read is an error.
    """
    if not path:
        return dict(SAMPLE_THESAURUS)
    found = json.loads(Path(path).read_text(encoding="utf-8"))
    if isinstance(found, dict):
        return {str(t): [str(a) for a in alternatives] for t, alternatives in found.items()}
    out: dict[str, list[str]] = {}
    for term, alternative in found:
        out.setdefault(str(term), []).append(str(alternative))
    return out


def load_taxonomy(path: str | None) -> dict[str, list[str]]:
    """The taxonomy, with the keys of a JSON file that hold lists replaced; a missing or broken file changes nothing."""
    if not path:
        return dict(TAXONOMY)
    try:
        found = json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError):
        return dict(TAXONOMY)
    lists = {k: [str(x) for x in v] for k, v in found.items() if isinstance(v, list)} if isinstance(found, dict) else {}
    return TAXONOMY | lists
