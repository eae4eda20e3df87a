"""Words, names and patterns that results depend on, in natural order."""

ALIASES = {
    "acetyl-coa": "Acetyl-CoA", "acetyl coa": "Acetyl-CoA", "acetyl coenzyme a": "Acetyl-CoA", "acetyl-coenzyme a": "Acetyl-CoA",
    "coa-sh": "CoA-SH", "hscoa": "CoA-SH", "coenzyme a": "CoA-SH",
    "nad": "NAD+", "nad+": "NAD+", "nadh": "NADH", "nadp": "NADP+", "nadp+": "NADP+", "nadph": "NADPH",
    "fad": "FAD", "fadh2": "FADH2", "fadh₂": "FADH2",
    "oxaloacetic acid": "oxaloacetate", "alpha-ketoglutarate": "α-ketoglutarate", "alpha ketoglutarate": "α-ketoglutarate",
    "2-oxoglutarate": "α-ketoglutarate", "2 oxoglutarate": "α-ketoglutarate", "succinic acid": "succinate", "fumaric acid": "fumarate",
    "malic acid": "malate", "citric acid": "citrate", "isocitric acid": "isocitrate", "pyruvic acid": "pyruvate",
    "phosphoenolpyruvate": "phosphoenolpyruvate", "pep": "phosphoenolpyruvate",
    "atp": "ATP", "adp": "ADP", "amp": "AMP", "gtp": "GTP", "gdp": "GDP",
    "pi": "Pi", "ppi": "PPi", "inorganic phosphate": "Pi", "inorganic pyrophosphate": "PPi",
}

PROTEIN_LIKE = "(protein|globulin|peroxidase|symporter|deiodinase|atpase|enzyme|receptor|transporter|kinase|phosphatase)"
SCAFFOLDS = ("thyroglobulin",)
BYPRODUCT_SUFFIX = "acid"
BYPRODUCTS = ("water", "proton", "oxygen", "hydrogen peroxide", "carbon dioxide", "phosphate", "pyrophosphate")

CATALYTIC = "(catalyz|catalys|enzyme|activat|catalytic|promotes|facilitate)"
INHIBITING = "(inhibit|block|suppress|downregulat|repress)"
TRANSPORTING = "(transport|carry|carri|shuttle|translocat)"

STOP_WORDS = "a an the and or of in to is are was were be been being by for with as at from on into that this it its also not no can may has have had do does did via per".split()

MODEL_PROTEIN_HINTS = ("enzyme", "peroxidase", "deiodinase", "symporter", "transporter", "atpase", "kinase", "phosphatase", "protein")
GENERIC_CLASSES = ("triacylglycerol", "diacylglycerol", "monoglyceride")

COMPARTMENTS = ("cytosol", "nucleus", "mitochondrion", "mitochondrial_matrix", "endoplasmic_reticulum", "golgi", "lysosome", "peroxisome", "plasma_membrane", "extracellular", "endosome")
COMPARTMENT_ALIASES = {
    "cytoplasm": "cytosol", "cytosolic": "cytosol", "cytoplasmic": "cytosol", "mitochondria": "mitochondrion", "mitochondrial": "mitochondrion",
    "mitochondrial matrix": "mitochondrial_matrix", "er": "endoplasmic_reticulum", "endoplasmic reticulum": "endoplasmic_reticulum",
    "golgi apparatus": "golgi", "golgi body": "golgi", "cell membrane": "plasma_membrane", "plasma membrane": "plasma_membrane",
    "extracellular space": "extracellular", "extracellular matrix": "extracellular", "nuclear": "nucleus", "peroxisomal": "peroxisome",
    "lysosomal": "lysosome", "endosomal": "endosome",
}

SECTION_HEADER = (
    r"(?i)^[ \t]*(?:\d[\d.]*\.?\s+)?(abstract|introduction|background|materials?\s+and\s+methods?|methods?\s+and\s+materials?|experimental\s+procedures?|methods?|"
    r"results?(?:\s+and\s+discussion)?|discussion(?:\s+and\s+conclusions?)?|conclusions?|summary|supplementary(?:\s+\w+)*|supplemental(?:\s+\w+)*|"
    r"supporting\s+information|references?|bibliography|acknowledgements?|acknowledgments?)[ \t]*$"
)
SECTION_RELEVANCE = {
    "results": 0.9, "results and discussion": 0.9, "discussion": 0.85, "discussion and conclusions": 0.85, "conclusion": 0.75, "summary": 0.75,
    "methods": 0.7, "abstract": 0.6, "preamble": 0.5, "supplementary": 0.5, "supporting information": 0.5, "introduction": 0.4, "background": 0.4,
    "references": 0.1, "bibliography": 0.1, "acknowledgements": 0.05, "acknowledgments": 0.05,
}
OTHER_SECTION_RELEVANCE = 0.5
MIN_RELEVANCE = 0.3

MODIFIER_TRIGGERS = r"(?i)\b(catalysis|catalytic|enzyme[-\s]mediated|enzymatic|phosphorylation|kinase|ase)\b"
TRANSPORT_NAMES = r"(?i)\b(import|export|transport|shuttle|translocation|trafficking)\b"
COMPLEX_NAMES = r"(?i)\b(complex|subunit|hetero|homo)\b|:"
COFACTORS = ("atp", "adp", "amp", "nadh", "nadph", "nad+", "nadp+", "fadh2", "fad", "coenzyme a", "coa", "acetyl-coa", "gtp", "gdp", "h2o", "water", "oxygen")

XREF_PREFIXES = {
    "hmdb": "urn:miriam:hmdb:", "kegg": "urn:miriam:kegg.compound:", "chebi": "urn:miriam:chebi:", "pubchem": "urn:miriam:pubchem.compound:",
    "drugbank": "urn:miriam:drugbank:", "uniprot": "urn:miriam:uniprot:",
}
BINOMIAL = r"^[A-Z][a-z]+(\.|)\s+[a-z][a-z-]+$"
