"""Rule tagging of methods into facets, stored-facet overlay, facet counts and facet filter."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskit.functions.text import fold, let

TAXONOMY_VERSION = 2

# Facets, their values and bilingual labels (Korean, English).
FACET_TITLES = {
    "purpose": ("목적", "Purpose"),
    "material": ("대상", "Material"),
    "core_principle": ("핵심 원리", "Core principle"),
    "detection": ("검출 방식", "Detection"),
    "labeling": ("표지 방식", "Labeling"),
    "output": ("결과", "Output"),
}
FACETS = tuple(FACET_TITLES)
FACET_VALUES = {
    "purpose": {
        "detect_quantify": ("검출·정량", "Detect / quantify"),
        "visualize_localize": ("시각화·위치 확인", "Visualize / localize"),
        "profile_expression": ("발현·분자 프로파일링", "Expression / molecular profiling"),
        "cell_identity": ("세포 분류·표현형", "Cell identity / phenotype"),
        "proliferation_viability": ("세포 증식·생존", "Proliferation / viability"),
        "interaction_binding": ("분자 상호작용", "Molecular interaction"),
        "perturb_edit": ("유전자·기능 조작", "Perturb / edit"),
        "chromatin_regulation": ("염색질·조절 분석", "Chromatin / regulation"),
        "functional_response": ("기능·반응 측정", "Functional response"),
        "morphology_tissue": ("조직·형태 분석", "Morphology / tissue"),
    },
    "material": {
        "dna": ("DNA", "DNA"),
        "rna": ("RNA", "RNA"),
        "protein": ("단백질", "Protein"),
        "cell": ("세포", "Cell"),
        "tissue": ("조직", "Tissue"),
        "chromatin": ("Chromatin", "Chromatin"),
        "secreted_factor": ("분비 단백질·cytokine", "Secreted factor / cytokine"),
        "reporter": ("Reporter", "Reporter"),
    },
    "core_principle": {
        "cytometry": ("Cytometry", "Cytometry"),
        "amplification": ("핵산 증폭", "Nucleic-acid amplification"),
        "sequencing": ("Sequencing", "Sequencing"),
        "hybridization": ("Hybridization", "Hybridization"),
        "electrophoretic_separation": ("전기영동 분리", "Electrophoretic separation"),
        "affinity_binding": ("Affinity binding", "Affinity binding"),
        "immunoprecipitation": ("Immunoprecipitation", "Immunoprecipitation"),
        "microscopy": ("Microscopy", "Microscopy"),
        "histology": ("Histology", "Histology"),
        "reporter_assay": ("Reporter assay", "Reporter assay"),
        "genome_editing": ("Genome editing", "Genome editing"),
        "cell_based_assay": ("Cell-based assay", "Cell-based assay"),
    },
    "detection": {
        "light_scatter": ("Light scatter", "Light scatter"),
        "fluorescence": ("형광", "Fluorescence"),
        "chemiluminescence": ("Chemiluminescence", "Chemiluminescence"),
        "colorimetric": ("Colorimetric", "Colorimetric"),
        "absorbance": ("Absorbance", "Absorbance"),
        "sequencing_readout": ("Sequence readout", "Sequence readout"),
        "electrical": ("전기적 신호", "Electrical signal"),
        "imaging": ("Image readout", "Image readout"),
    },
    "labeling": {
        "label_free": ("Label-free", "Label-free"),
        "antibody": ("항체", "Antibody"),
        "fluorescent_dye": ("형광 dye", "Fluorescent dye"),
        "fluorescent_protein": ("형광 단백질", "Fluorescent protein"),
        "nucleic_acid_probe": ("핵산 probe", "Nucleic-acid probe"),
        "enzyme_conjugate": ("효소 conjugate", "Enzyme conjugate"),
        "reporter_construct": ("Reporter construct", "Reporter construct"),
    },
    "output": {
        "abundance": ("양·발현량", "Abundance / expression"),
        "localization": ("세포·조직 내 위치", "Localization"),
        "population_frequency": ("세포 집단·빈도", "Population / frequency"),
        "single_cell_signal": ("Single-cell signal", "Single-cell signal"),
        "expression_matrix": ("발현 matrix", "Expression matrix"),
        "sequence_accessibility": ("Sequence·accessibility", "Sequence / accessibility"),
        "interaction": ("결합·상호작용", "Interaction / binding"),
        "morphology": ("형태·조직 구조", "Morphology / tissue structure"),
        "viability_function": ("생존·기능 readout", "Viability / functional readout"),
    },
}


def _quoted(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _any_of(text: str, markers: Sequence[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, {_quoted(m)})" for m in markers) + ")"


def _list_of(values: Sequence[str]) -> str:
    return f"array({', '.join(map(_quoted, values))})"


NO_VALUES = "cast(array() AS array<string>)"


@dataclass(frozen=True)
class Rule:
    """Adds facet values where any marker occurs in the folded text.

    ``also`` must occur as well (any of them); ``unless`` must not.
    """

    markers: Sequence[str]
    adds: Mapping[str, Sequence[str]]
    also: Sequence[str] = ()
    unless: Sequence[str] = ()

    def condition(self, text: str) -> str:
        """SQL condition over the column ``text``."""
        parts = [_any_of(text, self.markers)]
        if self.also:
            parts.append(_any_of(text, self.also))
        if self.unless:
            parts.append(f"NOT {_any_of(text, self.unless)}")
        return " AND ".join(parts)


@dataclass(frozen=True)
class RuleSet:
    facets: Sequence[str]
    rules: Sequence[Rule]
    # facet -> ordered (marker, value): used where the rules left the facet empty; marker "" always applies
    fallbacks: Mapping[str, Sequence[tuple[str, str]]] = field(default_factory=dict)


# Marker words of the assay rules and the facet values they add.
QPCR = ("qpcr", "quantitative pcr", "real-time pcr")
RNA_SEQ = ("rna sequencing", "rna-seq", "bulk rna", "scrna", "single-cell rna")
ASSAY_RULES = RuleSet(
    facets=FACETS,
    rules=(
        Rule(
            ("flow cytometry", "facs", "flow cytometric"),
            {
                "purpose": ["cell_identity"],
                "material": ["cell"],
                "core_principle": ["cytometry"],
                "detection": ["light_scatter", "fluorescence"],
                "labeling": ["label_free", "antibody", "fluorescent_dye", "fluorescent_protein"],
                "output": ["population_frequency", "single_cell_signal"],
            },
        ),
        Rule(
            ("mass cytometry", "cytof"),
            {
                "purpose": ["cell_identity"],
                "material": ["cell"],
                "core_principle": ["cytometry"],
                "labeling": ["antibody"],
                "output": ["population_frequency", "single_cell_signal"],
            },
        ),
        Rule(
            QPCR,
            {
                "purpose": ["detect_quantify"],
                "material": ["dna"],
                "core_principle": ["amplification"],
                "detection": ["fluorescence"],
                "labeling": ["fluorescent_dye", "nucleic_acid_probe"],
                "output": ["abundance"],
            },
        ),
        Rule(QPCR, {"material": ["rna"]}, also=("rt-qpcr", "reverse transcription", "gene expression")),
        Rule(
            ("pcr",),
            {
                "purpose": ["detect_quantify"],
                "material": ["dna"],
                "core_principle": ["amplification"],
                "output": ["abundance"],
            },
            unless=QPCR,
        ),
        Rule(
            RNA_SEQ,
            {
                "purpose": ["profile_expression"],
                "material": ["rna"],
                "core_principle": ["sequencing"],
                "detection": ["sequencing_readout"],
                "output": ["expression_matrix"],
            },
        ),
        Rule(RNA_SEQ, {"material": ["cell"]}, also=("scrna", "single-cell")),
        Rule(
            ("atac-seq", "atac seq", "atac"),
            {
                "purpose": ["chromatin_regulation"],
                "material": ["dna", "chromatin"],
                "core_principle": ["sequencing"],
                "detection": ["sequencing_readout"],
                "output": ["sequence_accessibility"],
            },
        ),
        Rule(
            ("chip-seq", "chip seq", "chromatin immunoprecipitation"),
            {
                "purpose": ["chromatin_regulation"],
                "material": ["dna", "chromatin", "protein"],
                "core_principle": ["immunoprecipitation", "sequencing"],
                "detection": ["sequencing_readout"],
                "labeling": ["antibody"],
                "output": ["sequence_accessibility"],
            },
        ),
        Rule(
            ("western blot", "western blotting"),
            {
                "purpose": ["detect_quantify"],
                "material": ["protein"],
                "core_principle": ["electrophoretic_separation"],
                "detection": ["chemiluminescence", "fluorescence"],
                "labeling": ["antibody", "enzyme_conjugate"],
                "output": ["abundance"],
            },
        ),
        Rule(
            ("elisa",),
            {
                "purpose": ["detect_quantify"],
                "material": ["protein", "secreted_factor"],
                "core_principle": ["affinity_binding"],
                "detection": ["colorimetric", "absorbance"],
                "labeling": ["antibody", "enzyme_conjugate"],
                "output": ["abundance"],
            },
        ),
        Rule(
            ("co-ip", "coimmunoprecip", "co-immunoprecip", "immunoprecipitation"),
            {
                "purpose": ["interaction_binding"],
                "material": ["protein"],
                "core_principle": ["immunoprecipitation"],
                "labeling": ["antibody"],
                "output": ["interaction"],
            },
        ),
        Rule(
            ("immunofluorescence", "confocal", "fluorescence microscopy"),
            {
                "purpose": ["visualize_localize"],
                "material": ["cell", "protein"],
                "core_principle": ["microscopy"],
                "detection": ["fluorescence", "imaging"],
                "labeling": ["antibody", "fluorescent_dye", "fluorescent_protein"],
                "output": ["localization"],
            },
        ),
        Rule(
            ("ihc", "immunohistochemistry", "histology"),
            {
                "purpose": ["morphology_tissue"],
                "material": ["tissue", "protein"],
                "core_principle": ["histology"],
                "detection": ["colorimetric", "imaging"],
                "labeling": ["antibody"],
                "output": ["localization", "morphology"],
            },
        ),
        Rule(
            ("crispr",),
            {
                "purpose": ["perturb_edit"],
                "material": ["dna"],
                "core_principle": ["genome_editing"],
                "output": ["viability_function"],
            },
        ),
        Rule(
            ("luciferase", "reporter assay", "reporter"),
            {
                "purpose": ["functional_response"],
                "material": ["reporter"],
                "core_principle": ["reporter_assay"],
                "detection": ["chemiluminescence"],
                "labeling": ["reporter_construct"],
                "output": ["viability_function"],
            },
        ),
        Rule(
            ("cell viability", "cytotoxicity", "viability assay"),
            {
                "purpose": ["proliferation_viability"],
                "material": ["cell"],
                "core_principle": ["cell_based_assay"],
                "detection": ["colorimetric", "fluorescence", "absorbance"],
                "output": ["viability_function"],
            },
        ),
        Rule(
            ("nanostring",),
            {
                "purpose": ["profile_expression"],
                "material": ["rna"],
                "core_principle": ["hybridization"],
                "labeling": ["nucleic_acid_probe"],
                "output": ["expression_matrix"],
            },
        ),
    ),
    fallbacks={
        "material": (("rna", "rna"), ("dna", "dna"), ("protein", "protein"), ("cell", "cell")),
        "purpose": (("", "detect_quantify"),),
    },
)


def method_haystack(name: str, category: str, parent: str, aliases: str, submethods: str) -> Column:
    """Folded text the rules look at."""

    def joined(c: str) -> Column:
        return F.array_join(F.coalesce(F.col(c), F.array().cast("array<string>")), " ")

    plain = [F.coalesce(c, F.lit("")) for c in (name, category, parent)]
    return fold(F.concat_ws(" ", *plain, joined(aliases), joined(submethods)))


def _facet(facet: str, rules: RuleSet) -> Column:
    """Values of one facet from the rule tests ``__rule<i>``, as one SQL expression (it has hundreds of nodes)."""
    picks = [
        f"if(__rule{i}, {_list_of(rule.adds[facet])}, {NO_VALUES})"
        for i, rule in enumerate(rules.rules)
        if facet in rule.adds
    ]
    values = F.expr(f"array_sort(array_distinct(concat({', '.join(picks)})))" if picks else NO_VALUES)
    steps = rules.fallbacks.get(facet, ())
    if not steps:
        return values
    cases = [f"WHEN {_any_of('__hay', [marker]) if marker else 'true'} THEN {_list_of([value])}" for marker, value in steps]
    fallback = F.expr(f"CASE {' '.join(cases)} ELSE {NO_VALUES} END")
    return let(values, lambda v: F.when(F.size(v) == 0, fallback).otherwise(v))


def tag_facets(methods: DataFrame, haystack: Column, rules: RuleSet = ASSAY_RULES) -> DataFrame:
    """Adds one sorted value list per facet.  Two projections: every rule is tested once, then the facets pick from the tests."""
    folded = methods.withColumn("__hay", haystack)
    tests = {f"__rule{i}": F.expr(rule.condition("__hay")) for i, rule in enumerate(rules.rules)}
    columns = {facet: _facet(facet, rules) for facet in rules.facets}
    tagged = folded.withColumns(tests).withColumns({**columns, "taxonomy_version": F.lit(TAXONOMY_VERSION)})
    return tagged.drop("__hay", *tests)


def overlay_facets(inferred: DataFrame, stored: DataFrame, key: str, facets: Sequence[str] = FACETS) -> DataFrame:
    """Stored facet lists replace inferred ones where their version is current and the list is not empty.

    ``stored(key, taxonomy_version, facets map<string, array<string>>)`` is unique on the key.
    """
    s = stored.select(key, F.col("taxonomy_version").alias("__version"), F.col("facets").alias("__stored"))
    joined = inferred.join(s, key, "left")

    def merged(facet: str) -> Column:
        own = F.try_element_at("__stored", F.lit(facet))
        trusted = (F.col("__version") == TAXONOMY_VERSION) & (F.size(own) > 0)
        return F.when(trusted, own).otherwise(F.col(facet))

    return joined.withColumns({facet: merged(facet) for facet in facets}).drop("__version", "__stored")


def facet_rows(tagged: DataFrame, key: str, facets: Sequence[str] = FACETS) -> DataFrame:
    """One row per (method, facet, value)."""
    pairs = F.array(*[F.struct(F.lit(f).alias("facet"), F.col(f).alias("values")) for f in facets])
    return tagged.select(key, F.explode(pairs).alias("__f")).select(key, "__f.facet", F.explode("__f.values").alias("value"))


def facet_counts(tagged: DataFrame, key: str, facets: Sequence[str] = FACETS) -> DataFrame:
    """Methods per facet value."""
    return facet_rows(tagged, key, facets).groupBy("facet", "value").agg(F.count("*").alias("n_methods"))


def filter_facets(tagged: DataFrame, selected: Mapping[str, Sequence[str]]) -> DataFrame:
    """OR inside a facet, AND across facets; a facet without selection does not filter."""
    out = tagged
    for facet, values in selected.items():
        if values:
            out = out.where(F.arrays_overlap(F.col(facet), F.array(*[F.lit(v) for v in values])))
    return out


def facet_label(facet: Column, value: Column, lang: str = "en", labels: Mapping = FACET_VALUES) -> Column:
    """Label of a facet value, the value itself where the vocabulary does not know it.

    The vocabulary is a fixed table of some fifty entries, so it is a literal map and needs no join.
    """
    pick = 0 if lang == "ko" else 1
    entries = [e for f, vs in labels.items() for v, names in vs.items() for e in (F.lit(f"{f}/{v}"), F.lit(names[pick]))]
    return F.coalesce(F.try_element_at(F.create_map(*entries), F.concat(facet, F.lit("/"), value)), value)


def facet_title(facet: Column, lang: str = "en", titles: Mapping = FACET_TITLES) -> Column:
    pick = 0 if lang == "ko" else 1
    entries = [e for f, names in titles.items() for e in (F.lit(f), F.lit(names[pick]))]
    return F.coalesce(F.try_element_at(F.create_map(*entries), facet), facet)
