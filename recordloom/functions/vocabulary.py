"""Word lists, lookup tables, patterns. Every operator takes them as parameters.

Patterns are written for java.util.regex; (?U) gives Unicode character classes.
"""

from __future__ import annotations

# -- fixed values: text artefacts ------------------------------------------------------------
SUBSCRIPT_DIGITS = ("₀₁₂₃₄₅₆₇₈₉", "0123456789")
LIGATURES = {
    "/uniFB00": "ff", "/uniFB01": "fi", "/uniFB02": "fl", "/uniFB03": "ffi", "/uniFB04": "ffl",
    "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl",
}
NA_TOKENS = ["", "-", "—", "–", "n.d.", "nd", "n/a", "na", "--", "/"]
FOOTNOTE = r"\[[a-zA-Z0-9]\]"
BRACKET = r"[\[\(]([^\]\)]*)[\]\)]"
SUPERSCRIPTS = r"[ᵃᵇᶜᵈᵉᶠᵍʰⁱʲᵏˡᵐⁿᵒᵖ¹²³⁰-ⁿ₊-₟]+"
UNIT_HINT = r"(?iU)%|°|g[⁻\-]|h[⁻\-]|mol|m²|m2|cm³|cm3|\bg\b|wt|μ|µ|nm|kj|mpa|bar|\bk\b|°c"
SEPARATORS = r"(?U)[\s\-_/()\[\].,;:]+"

# -- fixed values: table headers -------------------------------------------------------------
ID_HEADERS = ["catalyst", "catalysts", "sample", "samples", "material", "materials", "support",
              "zeolite", "system", "composition"]
REFERENCE_HEADERS = ["ref", "ref.", "refs", "reference", "references", "lit."]
SKIP_HEADERS = ["entry", "no.", "no", "index", "#"]
TABLE_TYPES = {
    "performance": ["conversion", "selectivity", "yield", "performance", "catalytic", "activity",
                    "productivity", "sty", "space-time", "space time", "tof", "ton",
                    "product distribution", "products", "btx", "aromatic", "xylene", "benzene",
                    "toluene", "olefin"],
    "textural": ["bet", "surface area", "pore", "textural", "physical", "crystallite",
                 "particle size", "porosity", "physisorption"],
    "acidity": ["acid", "nh3", "tpd", "bas", "las", "brønsted", "bronsted", "lewis", "acidity",
                "pyridine"],
    "composition": ["si/al", "composition", "loading", "content", "elemental", "xrf", "icp", "wt%",
                    "molar ratio", "atomic ratio"],
}
ACIDITY_ATTRS = ["total_acidity", "bronsted_acidity", "lewis_acidity", "weak_acidity",
                 "strong_acidity"]
COMPOSITION_ATTRS = ["si_al_ratio", "metal_loading_wt"]

# -- fixed values: families of attributes in reports -------------------------------------------
PERFORMANCE_FAMILY = ["conversion", "selectivity", "yield", "space_time", "tof", "rate", "benzene",
                      "toluene", "xylene", "aromatic", "olefin", "paraffin", "methane", "ethylene",
                      "propylene", "btx", "product_fraction"]
PROPERTY_FAMILY = ["surface_area", "pore", "acid", "si_al", "loading", "crystallite"]
ATTRIBUTE_ALIASES = {"co2_conv": "co2_conversion_pct", "co_conv": "co_conversion_pct",
                     "meoh_conversion_pct": "methanol_conversion_pct",
                     "s_bet": "bet_surface_area", "c_as": "total_acidity"}
FEATURE_GROUPS = {
    "conditions": ["temperature_c", "pressure", "whsv", "ghsv", "contact_time", "h2_co2_ratio",
                   "h2_co_ratio"],
    "texture": ["bet_surface_area", "total_pore_volume", "micropore_volume",
                "external_surface_area", "crystallinity_pct"],
    "acidity": ["total_acidity", "bronsted_acidity", "lewis_acidity", "weak_acidity",
                "strong_acidity", "bas_las_ratio"],
    "composition": ["si_al_ratio", "metal_loading_wt"],
    "performance": ["co2_conversion_pct", "co_conversion_pct", "methanol_conversion_pct",
                    "conversion_pct", "selectivity_pct", "aromatics_selectivity_pct",
                    "btx_selectivity_pct", "olefin_selectivity_pct", "methanol_selectivity_pct",
                    "space_time_yield", "yield_pct", "aromatics_yield_pct", "benzene_pct",
                    "toluene_pct", "xylenes_pct", "total_aromatics_pct", "btx_pct", "methane_pct",
                    "ethylene_pct", "propylene_pct", "light_olefins_pct", "paraffins_pct"],
}

# -- fixed values: chunk scoring and sections --------------------------------------------------
HIGH_VALUE_PATTERNS = [
    r"\bet al\.", r"\breported\b", r"\bfound\b", r"\bobserved\b", r"\bshowed\b", r"\bsuggested\b",
    r"\bproposed\b", r"\bselectivity\b", r"\byield\b", r"\bconversion\b", r"\bmechanism\b",
    r"\bdeactivation\b", r"\bcoke\b", r"\bpromoter?\b", r"\bsupport\b", r"\baromatization\b",
    r"\baromatic\b", r"\bBTX\b", r"\bZSM-5\b", r"\bzeolite\b", r"\bHZSM\b", r"\bmethanol\b",
    r"\bMTA\b", r"\bMTH\b", r"\bCO2\b", r"\bhydrogenation\b", r"\bRWGS\b", r"\bGa\b", r"\bZn\b",
    r"\bCu\b", r"\bMo\b", r"\bCo\b", r"\bMPa\b", r"\b°C\b", r"\bGHSV\b",
    r"%\s*(selectivity|conversion|yield)", r"\[[0-9,–\- ]+\]",
]
SECTION_WORDS = (
    r"abstract|introduction|experimental(?:\s+section)?|materials?\s+and\s+methods?|"
    r"methods?\s+and\s+materials?|methods?|materials?|synthesis|catalyst\s+preparation|"
    r"results?(?:\s+and\s+discussion)?|discussion|conclusions?|acknowledgem\w*|references?|"
    r"supporting\s+information|appendix"
)
# every section name holds one of these
SECTION_STEMS = ["abstract", "introduction", "experimental", "material", "method", "synthesis",
                 "preparation", "result", "discussion", "conclusion", "acknowledgem", "reference",
                 "information", "appendix"]
DROPPED_SECTIONS = ["introduction", "acknowledgements", "acknowledgments", "references",
                    "supporting information", "appendix"]
KEPT_SECTIONS = ["abstract", "experimental", "experimental section", "materials and methods",
                 "methods and materials", "methods", "synthesis", "catalyst preparation"]
SECTION_CLASSES = {
    "abstract": r"abstract",
    "introduction": r"introduction",
    "experimental": r"experiment|method|synthesis|catalyst\s+prep|materials?\s+and",
    "characterization": r"characteriz|characteris",
    "results": r"results?\s*(and|&)?\s*discuss|results?$|discussion",
    "conclusions": r"conclusion|summary",
    "references": r"references?$|bibliography",
    "skip": r"acknowledg|author\s+info|associated\s+content|supporting\s+info|access$|notes$|conflicts?",
}
REVIEW_WORDS = ["review", "survey", "perspective", "progress"]

# -- fixed values: column names of digital tables to unit fields (first match wins) ------------
COLUMN_FIELDS = {
    r"methanol\s*conv|meoh\s*conv": "methanol_conv_pct",
    r"co₂\s*conv|co2\s*conv|x\s*[\(\-_ ]?co2": "co2_conv_pct",
    r"\bco\s*conv|x\s*[\(\-_ ]?co\b": "co_conv_pct",
    r"conv(?:ersion)?[\s.]*\(?%": "conversion_pct",
    r"aromatic.*sel|^aromatics$": "aromatic_sel_pct",
    r"btx.*sel|^btx$": "btx_sel_pct",
    r"benzene.*sel": "benzene_pct",
    r"toluene.*sel": "toluene_pct",
    r"xylene.*sel": "xylene_pct",
    r"olefin.*sel": "olefin_pct",
    r"ethylene.*sel": "ethylene_pct",
    r"propylene.*sel": "propylene_pct",
    r"lifetime|catalyst\s*life": "lifetime_h",
    r"tos|time.on.stream": "tos_h",
    r"coke.*content|coke.*wt": "coke_content_wt",
    r"\(\s*K\s*\)|/\s*K\s*$|temperature.*\bK\b": "temperature_k",
    r"temp.*[°℃C]|T\s*/\s*[°℃C]|temperature": "temperature_c",
    r"press.*MPa|P\s*/\s*MPa": "pressure_mpa",
    r"whsv": "whsv",
    r"ghsv": "ghsv",
    r"br[øo]nsted|BAS|B\s*acid": "bas_umol_g",
    r"lewis|LAS|L\s*acid": "las_umol_g",
    r"B\s*/\s*L|B/L": "bl_ratio",
    r"total\s*acid|NH3.*total": "total_acid_umol_g",
    r"strong\s*acid|NH3.*strong": "strong_acid_umol_g",
    r"weak\s*acid|NH3.*weak": "weak_acid_umol_g",
    r"S\s*BET|BET|surface\s*area.*m": "bet_m2_g",
    r"S[\s_]*(?:Micro|micro)|micropore.*area": "micropore_sa_m2_g",
    r"S\s*(?:Exter|exter)|external.*area": "external_sa_m2_g",
    r"V\s*(?:Total|total)|total.*(?:pore|vol)": "total_pore_vol_cm3_g",
    r"V\s*(?:Micro|micro)|micropore.*vol": "micropore_vol_cm3_g",
    r"V\s*(?:Meso|meso)|mesopore.*vol": "mesopore_vol_cm3_g",
    r"Si\s*/\s*Al|SiO.*Al.*O|si.al": "si_al_ratio",
    r"crystal.*size|particle.*size": "crystal_size_nm",
    r"^sample$|^catalyst[\s_]?(?:name|system)?$|^zeolite$|^entry$": "catalyst_system",
}
EMPTY_CELLS = ["", "-", "−", "–", "—", "n/a", "N/A", "nd", "ND"]

# -- fixed values: material names ------------------------------------------------------------
KNOWN_SUPPORTS = ["Al2O3", "CNT", "CeO2", "HZSM-5", "La2O3", "MCM-41", "MOF", "MgO", "SAPO-34",
                  "SBA-15", "SiO2", "TiO2", "ZnO", "ZrO2", "activated carbon", "carbon",
                  "graphene", "zeolite"]
KNOWN_PROMOTERS = ["K", "Na", "Cs", "Rb", "Li", "Ca", "Ba", "Sr", "Mg", "La", "Ce", "Pr", "Sm",
                   "Mn", "V", "Cr"]
KNOWN_ACTIVES = ["Cu", "Fe", "Co", "Rh", "Ru", "Pd", "Pt", "Ni", "In", "Ga", "Zn"]
NOT_FORMULAE = ["CO2", "H2", "CO", "N2", "O2", "H2O", "He", "Ar", "CH4", "In", "At", "No", "As",
                "Is", "Be", "Can", "Do"]
QUANTITY_UNITS = (
    r"%|°\s*C|K\b|MPa|bar\b|atm\b|mL\s*g?[-\s]?1|mL/g|mmol\s*g[-\s]?1|mmol/g|"
    r"h[-\s]?1|h\^[-\s]?1|/h|cm3\s*g[-\s]?1|mol\s*%|wt\s*%|vol\s*%|ppm|nm\b|"
    r"m2\s*g[-\s]?1|μmol\s*g[-\s]?1"
)
UNIT_KINDS = {"%": "percentage", "°c": "temperature", "k": "temperature", "mpa": "pressure",
              "bar": "pressure", "atm": "pressure", "wt%": "weight_fraction",
              "mol%": "mole_fraction", "vol%": "volume_fraction", "nm": "particle_size",
              "h": "rate_or_time", "ppm": "concentration"}

# -- fixed values: figure captions and axes ----------------------------------------------------
CAPTION_CHARACTERISATION = [
    "xrd", "raman", " tpd", "tpr", " ir ", "ftir", "infrared", "pyridine", " sem", " tem",
    "haadf", " nmr", "physisorption", "isotherm", " xps", "uv-vis", "uv–vis", "tga",
    "diffraction", "spectra", "spectrum", "morphology", "adsorption-desorption", "bet surface",
    "27al", "29si", "characterization", "micrograph", "edx", "eds mapping"]
CAPTION_PERFORMANCE = [
    "conversion", "selectiv", "yield", "product distribution", "product profile", "productivity",
    "space-time", "space time", "stability", "time on stream", "time-on-stream",
    "catalytic performance", "regeneration", "deactivation", " tof ", "turnover"]
CAPTION_STRUCTURE = ["effect of", "as a function of", " vs ", "versus", "relationship",
                     "correlation", "influence of", "dependence", "with different"]
CAPTION_BAR = ["distribution", "profile of mta", "product profile"]
ACTIVITY_TYPES = ["activity", "structure_activity", "mixed"]
AXIS_STRUCTURE = {
    "si_al": ["si/al", "sio2/al2o3", "si:al", "si-al"],
    "metal_loading": ["loading", "wt%", "wt %", "content", "metal/"],
    "acidity": ["acid", "bas", "las", "bronsted", "brønsted", "lewis", "nh3", "acidity"],
    "bet_area": ["bet", "surface area", "specific surface"],
    "pore": ["pore volume", "pore size", "pore diameter"],
    "crystallinity": ["crystallinity"],
    "coverage": ["coverage", "atoms nm", "atoms/nm", "monolayer"],
    "ratio_descriptor": ["acid/metal", "acid-to-metal", "n_acid", "proximity"],
}
AXIS_CONDITION = ["temperature", "temp", "°c", "pressure", "mpa", "bar", "whsv", "ghsv", "tos",
                  "time on stream", "time-on-stream", "contact time", "cycle", "h2/co",
                  "reaction time", "space velocity"]
AXIS_PERFORMANCE = ["conversion", "selectivity", "yield", "sty", "space-time", "productivity",
                    "tof", "ton", "activity"]
STRUCTURE_ATTRS = ["si_al", "si/al", "sio2_al2o3", "bet", "surface_area", "pore", "bronsted",
                   "lewis", "bas_las", "las_", "_las", "acid", "acidity", "crystallin", "loading",
                   "topology", "composition", "channel", "framework", "metal_content",
                   "dispersion", "particle", "coverage", "monolayer", "proximity"]
NOT_STRUCTURE_ATTRS = ["conversion", "selectiv", "yield", "_pct", "temperature", "pressure",
                       "ghsv", "whsv", "contact", "space_time", "tos", "h2_co2", "h2_co",
                       "ratio_h", "methane", "ethylene", "aromatics", "propylene", "co_", "_co",
                       "formation"]

# -- fixed values: venue tiers (name, tier, approximate impact) ---------------------------------
VENUE_TIERS = [
    ("Nature Catalysis", "S", 42.0), ("Nature Energy", "S", 60.0),
    ("Energy & Environmental Science", "S", 32.0), ("Joule", "S", 39.0),
    ("ACS Energy Letters", "S", 19.0), ("Angewandte Chemie International Edition", "S", 16.1),
    ("Angewandte Chemie", "S", 16.1), ("Journal of the American Chemical Society", "S", 15.0),
    ("Applied Catalysis B: Environmental", "A", 22.1),
    ("Applied Catalysis B: Environment and Energy", "A", 22.1),
    ("Chemical Engineering Journal", "A", 15.1), ("ACS Catalysis", "A", 12.9),
    ("Advanced Functional Materials", "A", 18.5), ("Advanced Energy Materials", "A", 27.8),
    ("Chemical Science", "A", 9.0), ("ChemSusChem", "A", 8.1), ("Green Chemistry", "A", 9.8),
    ("Nano Energy", "A", 17.6), ("Journal of Catalysis", "B", 6.9),
    ("Applied Catalysis A: General", "B", 5.4), ("Catalysis Today", "B", 5.9),
    ("ChemCatChem", "B", 5.0), ("Catalysis Science & Technology", "B", 5.0), ("Fuel", "B", 7.0),
    ("Industrial & Engineering Chemistry Research", "B", 4.2),
    ("Microporous and Mesoporous Materials", "B", 4.8), ("Fuel Processing Technology", "B", 5.8),
    ("Molecular Catalysis", "B", 4.0), ("Journal of CO2 Utilization", "B", 7.1),
    ("International Journal of Hydrogen Energy", "B", 7.2),
    ("Catalysis Communications", "C", 3.5), ("Reaction Chemistry & Engineering", "C", 4.0),
    ("Chinese Journal of Catalysis", "C", 6.7), ("Journal of Energy Chemistry", "C", 13.1),
    ("New Journal of Chemistry", "C", 3.1), ("RSC Advances", "C", 3.9),
]
VENUE_EXACT = {"nature": ("S", 50.0), "science": ("S", 45.0), "chem": ("S", 19.0)}
TIER_ORDER = {"S": 0, "A": 1, "B": 2, "C": 3, "?": 4}
