"""The pattern catalog: what is recognised, and what speaks against a match.

Patterns are rows.  Their expressions are written in the dialect of web pages;
``python_regex`` and ``java_regex`` translate the few constructs that differ
(word boundaries and white space), so that the scan kernel and Spark's own
expressions agree.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The 25 white-space code points of the catalog's dialect.
WS = "\t\n\x0b\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
CATEGORIES = ("citation", "math", "physics", "biology", "cs", "chemistry", "default")


@dataclass(frozen=True)
class Falsifier:
    """One reason to drop a match.

    kind: ``context`` (words in its sentence), ``before`` / ``after`` (a string
    that the neighbourhood ends with, or an expression found in it), ``parent``
    (tag and class of the text's element) or ``confidence`` (below a value).
    """

    kind: str
    words: tuple[str, ...] = ()
    regex: str | None = None
    text: str | None = None
    tag: str | None = None
    css_class: str | None = None
    below: float | None = None


@dataclass(frozen=True)
class Pattern:
    id: str
    label: str
    category: str
    regex: str
    flags: str = "g"
    priority: int = 0
    tooltip: str = ""
    falsifiers: tuple[Falsifier, ...] = ()
    exclude_in_sentence: tuple[str, ...] = ()


@dataclass(frozen=True)
class PatternSet:
    id: str
    name: str
    patterns: tuple[Pattern, ...] = field(default=())


def _parents(*tags: str) -> tuple[Falsifier, ...]:
    return tuple(Falsifier("parent", tag=t) for t in tags)


# The identifiers, expressions, flags, labels and word lists below define the results.
CITATIONS = PatternSet("citations", "Citations", (
    Pattern("arxiv.id", "arXiv ID", "citation", r"arXiv:\s*(\d{4}\.\d{4,5}(?:v\d+)?)", "gi", 1, "arXiv preprint", _parents("CODE", "PRE")),
    Pattern("arxiv.abs", "arXiv abstract URL", "citation", r"arxiv\.org/(?:abs|pdf)/(\d{4}\.\d{4,5}(?:v\d+)?)", "gi", 0, "arXiv link"),
    Pattern("doi", "DOI", "citation", r"\b10\.\d{4,9}/[-._;()/:A-Z0-9]+\b", "gi", 0, "Digital Object Identifier", (Falsifier("after", regex=r"^[;,]\s*10\."),)),
    Pattern("doi.url", "doi.org URL", "citation", r"""doi\.org/(10\.\d{4,9}/[^\s"'<>]+)""", "gi", 0, "DOI link"),
    Pattern("pmid", "PubMed ID", "citation", r"(?:PMID:?\s*|pubmed\.ncbi\.nlm\.nih\.gov/)(\d{6,9})(?!\d)", "g", 0, "PubMed reference"),
    Pattern("pmcid", "PMC ID", "citation", r"(?:\b|(?:pmc\.ncbi\.nlm\.nih\.gov/articles/))(PMC\d{4,8})(?!\d)", "g", 0, "PubMed Central"),
    Pattern("github", "GitHub repo", "citation", r"(https?://github\.com/[A-Za-z0-9][A-Za-z0-9._-]+/[A-Za-z0-9._-]+?)(?:\.git)?(?=\s|[#/?]|$)", "gi", 0, "GitHub repository"),
    Pattern("biorxiv", "bioRxiv", "citation", r"(?:(?:www\.)?biorxiv\.org/content/)(10\.\d{4,9}/[-._;()/:A-Z0-9]+)", "gi", 0, "bioRxiv preprint"),
    Pattern("medrxiv", "medRxiv", "citation", r"(?:(?:www\.)?medrxiv\.org/content/)(10\.\d{4,9}/[-._;()/:A-Z0-9]+)", "gi", 0, "medRxiv preprint"),
))

#: Words that make a quantity a matter of geography.
GEOGRAPHY = (
    "depth", "magnitude", "epicenter", "epicentre", "altitude", "elevation", "tsunami", "aftershock", "earthquake", "fault", "tectonic",
    "seismolog", "geolog", "oceanic", "kilomet", "kilometer", "miles", "feet", "off the coast", "from the", "located", "coast",
)

SCIENCE = PatternSet("science", "Science (English)", (
    Pattern("math.theorem", "Math theorem", "math", r"\b(?:Theorem|Lemma|Corollary|Proposition|Conjecture|Claim|Remark)\s+(\d+(?:\.\d+)*)\b", tooltip="Numbered mathematical statement"),
    Pattern("math.definition", "Math definition", "math", r"\b(?:Definition|Def\.?|Axiom|Hypothesis)\s+(\d+(?:\.\d+)*)\b", tooltip="Numbered definition"),
    Pattern("math.equation", "Equation number", "math", r"\((?:eq\.?|equation)?\s*(\d+)\)", tooltip="Equation reference", falsifiers=(Falsifier("before", regex=r"\d\($"),)),
    Pattern("math.bigO", "Big-O", "math", r"\bO\([^)\n]{1,40}\)", tooltip="Asymptotic complexity"),
    Pattern("physics.particle", "Particle", "physics", r"\b(?:muon|tauon?|pion|kaon|proton|neutron|electron|positron|photon|gluon|graviton|W boson|Z boson|Higgs boson|quark|lepton|boson|fermion|hadron|meson|baryon)\b", tooltip="Standard Model / subatomic particle"),
    Pattern("physics.detector", "Detector / Lab", "physics", r"\b(?:ATLAS|CMS|LIGO|Virgo|IceCube|Fermilab|CERN|SLAC|KEK|DESY)(?:[- ][A-Z][A-Za-z0-9]+){0,1}", tooltip="Physics detector or laboratory"),
    Pattern("physics.units", "Physical unit", "physics", "\\b\\d+(?:\\.\\d+)?\\s*(?:GeV|MeV|keV|TeV|fm|pm|nm|µm|kg|eV|ps|ns|us|ms)\\b", tooltip="Quantity with SI / particle-physics unit", falsifiers=(Falsifier("context", words=GEOGRAPHY),)),
    Pattern("chem.formula", "Chemical formula", "chemistry", r"\b(?:H2O|CO2|N2|O2|H2|Cl2|NaCl|HCl|H2SO4|HNO3|H3PO4|NH3|CH4|C2H6|C3H8|C6H6|C6H12O6|CH3OH|C2H5OH|CaCO3|Fe2O3|TiO2|SiO2)\b", priority=1, tooltip="Common chemical formula"),
    Pattern("bio.gene", "Gene symbol", "biology", r"\b[A-Z][A-Z0-9]{1,5}\d[A-Z0-9]?\b", tooltip="HGNC-style gene symbol (e.g. TP53, BRCA1, ABCA1)", falsifiers=_parents("H1", "H2", "H3", "TITLE")),
    Pattern("bio.protein", "Protein family", "biology", "(?:p53|pRB|Ras|Raf|Mek|Erk|Akt|Stat\\d?|TGF[αβ]|TNF[α]|Hsp\\d+)", tooltip="Named protein or family"),
    Pattern("bio.technique", "Biology technique", "biology", r"\b(?:qPCR|RT-PCR|qRT-PCR|ELISA|Western blot|Southern blot|Northern blot|CRISPR(?:/Cas\d+)?|ChIP-seq|RNA-seq|scRNA-seq|ATAC-seq|Hi-C|FISH|IHC|flow cytometry)\b", "gi", 0, "Wet-lab or sequencing technique"),
    Pattern("bio.taxonomy", "Binomial nomenclature", "biology", r"\b(?:Escherichia|Drosophila|Saccharomyces|Arabidopsis|Caenorhabditis|Toxoplasma|Plasmodium|Mycobacterium|Staphylococcus|Streptococcus|Salmonella|Listeria|Helicobacter|Pseudomonas|Mycoplasma|Candida|Neurospora|Aspergillus|Zea|Oryza|Triticum|Glycine|Rattus|Gallus|Apis|Bos|Sus|Homo)\s+[a-z]{3,}\b|\bMus\s+musculus\b", tooltip="Genus + species (binomial)"),
    Pattern("cs.venue", "CS venue", "cs", r"\b(?:NeurIPS|ICML|ICLR|ACL|EMNLP|NAACL|CVPR|ICCV|ECCV|AAAI|IJCAI|UAI|KDD|SIGGRAPH|CHI|USENIX|SOSP|OSDI|FAST|ASPLOS|POPL|PLDI)(?:\s\d{2,4}|'\d{2,4})?", tooltip="Major CS / ML conference"),
    Pattern("cs.model", "ML model family", "cs", r"\b(?:Transformer|GPT-[1-9](?:\.\d+)?[A-Z]?|BERT(?:\-[A-Za-z]+)?|RoBERTa|T5|Llama(?:[-\s]?\d+)?|LLaMA|Mistral|Mixtral|Gemma|DeepSeek|Qwen|Claude|GPT-4o|RNN|LSTM|GRU|CNN|GAN|VAE|Diffusion|ResNet(?:-\d+)?|EfficientNet|ViT(?:-\d+)?)\b", "gi", 0, "Named ML architecture or model"),
    Pattern("cs.dataset", "ML dataset", "cs", r"\b(?:MNIST|CIFAR(?:-\d+)?|ImageNet|GLUE|SuperGLUE|SQuAD|MS-COCO|COCO|CommonCrawl|The Pile|WikiText|LAION|HuggingFaceH4)\b", tooltip="Common ML evaluation dataset"),
))
#: Names that a search for keywords must find beside the patterns' labels.
KEYWORDS = (
    "arXiv:2401.01234", "arXiv:2412.12345", "arXiv:2605.22166", "10.1038/nature12373", "10.1126/science.aaa8680",
    "Llama-3", "GPT-4o", "Mistral", "Phi-3", "Gemma", "DeepSeek", "BERT", "RoBERTa", "T5", "Mixtral", "Qwen", "Transformer", "ResNet", "ViT", "CNN", "LSTM", "GAN", "VAE",
    "H2O", "CO2", "H2SO4", "Z boson", "W boson", "Higgs boson", "TP53", "BRCA1", "Ras", "Akt", "p53",
    "MNIST", "CIFAR-10", "ImageNet", "GLUE", "SQuAD", "NeurIPS", "ICML", "ACL",
)
# End of the fixed values.


class Catalog:
    """Registered sets, in registration order; that order is the last tie-break of a scan."""

    def __init__(self, *sets: PatternSet):
        self.sets: list[PatternSet] = []
        for s in sets:
            self.register(s)

    def register(self, pattern_set: PatternSet) -> Catalog:
        for p in pattern_set.patterns:
            if "g" not in p.flags:
                raise ValueError(f"{p.id}: a pattern is matched everywhere, its flags need g")
            if p.category not in CATEGORIES:
                raise ValueError(f"{p.id}: unknown category {p.category}")
        self.sets.append(pattern_set)
        return self

    def patterns(self, sets: list[str] | None = None, category: str | None = None) -> list[Pattern]:
        """Compiled rows: a sentence exclusion becomes a context falsifier."""
        chosen = [p for s in self.sets if sets is None or s.id in sets for p in s.patterns if category in (None, p.category)]
        return [
            replace(p, falsifiers=(*p.falsifiers, Falsifier("context", words=p.exclude_in_sentence)), exclude_in_sentence=())
            if p.exclude_in_sentence else p
            for p in chosen
        ]

    def frame(self, spark: SparkSession, sets: list[str] | None = None) -> DataFrame:
        """ord, set_id, set_name, id, label, category, regex, flags, priority, tooltip, n_falsifiers."""
        rows = [(s.id, s.name, p) for s in self.sets if sets is None or s.id in sets for p in s.patterns]
        return spark.createDataFrame(
            [(i, sid, name, p.id, p.label, p.category, p.regex, p.flags, p.priority, p.tooltip, len(p.falsifiers)) for i, (sid, name, p) in enumerate(rows)],
            "ord int, set_id string, set_name string, id string, label string, category string, regex string, flags string, priority int, tooltip string, n_falsifiers int",
        )


def keywords(catalog: Catalog, spark: SparkSession) -> DataFrame:
    """keyword: the labels and tooltips of all patterns and the fixed names, each once, in order."""
    rows = catalog.frame(spark)
    named = spark.createDataFrame([(k,) for k in KEYWORDS], "keyword string")
    each = rows.select(F.trim("label").alias("keyword")).union(rows.select(F.trim("tooltip"))).union(named)
    return each.where("keyword <> ''").distinct().orderBy("keyword")


def default_catalog() -> Catalog:
    return Catalog(CITATIONS, SCIENCE)


def dialect_spaces(regex: str) -> str:
    """``\\s`` as the dialect's own class, inside of brackets and outside."""
    out, inside, i = [], False, 0
    while i < len(regex):
        two = regex[i : i + 2]
        if two == r"\s":
            out.append(WS if inside else f"[{WS}]")
            i += 2
            continue
        if two[0] == "\\":
            out.append(two)
            i += 2
            continue
        inside = two[0] == "[" if not inside else two[0] != "]"
        out.append(two[0])
        i += 1
    return "".join(out)


def python_regex(regex: str, flags: str = "g") -> re.Pattern:
    """For Python's ``re``: ASCII classes and boundaries, the end of the text for ``$``."""
    return re.compile(re.sub(r"(?<!\\)\$", r"\\Z", dialect_spaces(regex)), re.ASCII | (re.IGNORECASE if "i" in flags else 0))


def java_regex(regex: str, flags: str = "g") -> str:
    """For Spark's expressions: a boundary looks at ASCII word characters only.

    Before a word character it needs to look behind only, which is what most
    patterns start with and so what every place of a text pays for.
    """
    word = "0-9A-Za-z_"
    edge = rf"(?:(?<![{word}])(?=[{word}])|(?<=[{word}])(?![{word}]))"
    out = re.sub(r"(?<!\\)\$", r"\\z", dialect_spaces(regex))
    out = re.sub(r"\\b(?=(?:\((?:\?:)?)*(?:\[?[0-9A-Za-z_]|\\d))", lambda _: f"(?<![{word}])", out)
    out = out.replace(r"\b", edge)
    return f"(?i){out}" if "i" in flags else out
