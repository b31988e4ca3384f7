"""Word lists, closed vocabularies and patterns of the search language.

Fixed values: results depend on each of them.
"""

from __future__ import annotations

# Words that retrieval leaves out of token sets.
RETRIEVAL_STOPWORDS = (
    "a an the and or but in on at to for of with by from as is was are were been be have has had do does did "
    "will would could should may might must shall can need about above after before between into through during "
    "under again further then once here there when where why how all each few more most other some such no not "
    "only own same so than too very just also now papers paper articles article studies study research work works "
    "published find search looking want show me get list i my we our you your it its this that these those which "
    "what who whose whom any every many"
).split()

# Words that are no topic.
TOPIC_STOPWORDS = (
    "a an the is are was were be been being have has had do does did will would could should may might must shall "
    "can need ought i you he she it we they what which who whom this that these those am having for and nor but or "
    "yet so at by with about against between into through during before after above below to from up down in of out "
    "on off over under again further then once here there when where why how all each few more most other some such "
    "no not only own same than too very papers paper articles article publications publication studies study "
    "research work works find show get me search look looking give please"
).split()

# Words that are no author's name.
AUTHOR_NOISE = "the and or about on in from with papers paper articles article publications".split()

# Operators that an intent can have.
OPERATORS = ("citations", "references", "reviews", "similar", "trending", "useful")
# Calls that repair knows.
CALLS = ("citations", "references", "trending", "useful", "similar", "reviews", "topn")

FIELDS = (
    "abs abstract title keyword full body ack author ^author author_count orcid orcid_pub orcid_user aff aff_id inst "
    "bibcode bibstem bibgroup pub pubdate year volume issue page doctype doi arXiv arxiv_class identifier "
    "alternate_bibcode citation_count read_count cite_read_boost classic_factor data property esources object "
    "database collection lang copyright grant entdate editor book_author caption comment alternate_title"
).split()

DOCTYPES = (
    "abstract article book bookreview catalog circular editorial eprint erratum inbook inproceedings mastersthesis "
    "misc newsletter obituary phdthesis pressrelease proceedings proposal software talk techreport"
).split()
PROPERTIES = (
    "ads_openaccess author_openaccess eprint_openaccess pub_openaccess openaccess article nonarticle refereed "
    "notrefereed eprint inproceedings software catalog associated data esource inspire library_catalog presentation "
    "toc ocr_abstract"
).split()
COLLECTIONS = "astronomy physics general earthscience".split()
BIBGROUPS = [
    *(
        "HST JWST Spitzer Chandra XMM GALEX Kepler K2 TESS FUSE IUE EUVE Copernicus IRAS WISE NEOWISE Fermi Swift RXTE "
        "NuSTAR SOHO STEREO SDO ESO/Telescopes CFHT Gemini Keck VLT Subaru NOAO NOIRLab CTIO KPNO Pan-STARRS SDSS 2MASS "
        "UKIRT ALMA JCMT APEX ARECIBO VLA VLBA GBT LOFAR MeerKAT SKA Gaia Hipparcos CfA LISA LIGO SETI ESO"
    ).split(),
    "NASA PubSpace",
]
ESOURCES = "PUB_PDF PUB_HTML EPRINT_PDF EPRINT_HTML AUTHOR_PDF AUTHOR_HTML ADS_PDF ADS_SCAN".split()
DATA_SOURCES = (
    "ARI BICEP2 Chandra CXO ESA ESO GCPD GTC HEASARC Herschel INES IRSA ISO KOA MAST NED NExScI NOAO PDS SIMBAD "
    "Spitzer TNS VizieR XMM"
).split()
ENUMS = {
    "doctype": DOCTYPES,
    "collection": COLLECTIONS,
    "database": COLLECTIONS,
    "property": PROPERTIES,
    "bibgroup": BIBGROUPS,
    "esources": ESOURCES,
    "data": DATA_SOURCES,
}

PROPERTY_SYNONYMS = {
    "refereed": "refereed", "peer reviewed": "refereed", "peer-reviewed": "refereed", "reviewed": "refereed",
    "open access": "openaccess", "open-access": "openaccess", "oa": "openaccess", "free": "openaccess",
    "arxiv": "eprint", "preprint": "eprint", "preprints": "eprint", "eprint": "eprint",
}
DOCTYPE_SYNONYMS = {
    "article": "article", "articles": "article", "journal article": "article", "journal articles": "article",
    "paper": "article", "papers": "article", "publication": "article", "publications": "article",
    "thesis": "phdthesis", "phd": "phdthesis", "phd thesis": "phdthesis", "dissertation": "phdthesis",
    "masters thesis": "mastersthesis", "masters": "mastersthesis", "master's thesis": "mastersthesis",
    "preprint": "eprint", "preprints": "eprint", "arxiv": "eprint",
    "conference": "inproceedings", "conference paper": "inproceedings", "conference papers": "inproceedings", "proceedings": "inproceedings",
    "software": "software", "code": "software", "book": "book", "books": "book", "monograph": "book",
    "review": "article", "review article": "article", "review articles": "article",
}
BIBGROUP_SYNONYMS = {
    "hubble": "HST", "hubble space telescope": "HST", "hst": "HST", "webb": "JWST", "james webb": "JWST",
    "james webb space telescope": "JWST", "jwst": "JWST", "spitzer": "Spitzer", "spitzer space telescope": "Spitzer",
    "chandra": "Chandra", "chandra x-ray": "Chandra", "kepler": "Kepler", "kepler mission": "Kepler", "tess": "TESS",
    "fermi": "Fermi", "fermi gamma": "Fermi", "gaia": "Gaia", "xmm": "XMM", "xmm-newton": "XMM", "sloan": "SDSS",
    "sdss": "SDSS", "sloan digital sky survey": "SDSS", "alma": "ALMA", "vlt": "VLT", "very large telescope": "VLT",
    "keck": "Keck", "gemini": "Gemini", "subaru": "Subaru", "ligo": "LIGO", "gravitational wave": "LIGO",
    "gravitational waves": "LIGO",
}
COLLECTION_SYNONYMS = {
    "astronomy": "astronomy", "astro": "astronomy", "astrophysics": "astronomy", "physics": "physics", "general": "general",
    "earthscience": "earthscience", "earth science": "earthscience", "earth sciences": "earthscience",
    "geoscience": "earthscience", "geosciences": "earthscience", "planetary science": "earthscience",
    "planetary sciences": "earthscience", "heliophysics": "earthscience", "space weather": "earthscience",
}

# Phrases that ask for an operator; operators are tried in this order.
OPERATOR_PHRASES = {
    "references": [
        r"sources?\s+cited\s+by", r"works?\s+cited\s+by", r"references?\s+of", r"references?\s+from",
        r"papers?\s+referenced\s+by", r"bibliography\s+of", r"what\s+did\s+.+\s+cite", r"papers?\s+cited\s+in",
        r"cited\s+in", r"what\s+does\s+.+\s+cite", r"what\s+papers?\s+does\s+.+\s+cite", r"papers?\s+it\s+cites",
        r"papers?\s+they\s+cite", r"references?\s+in\s+(the\s+)?(paper|bibliography|appendix)",
        r"sources?\s+in\s+(the\s+)?(paper|bibliography|appendix)", r"show\s+references?", r"list\s+references?",
    ],
    "citations": [
        r"cited\s+by", r"papers?\s+citing", r"who\s+cited", r"citations?\s+to", r"citations?\s+of", r"find\s+citations?",
        r"get\s+citations?", r"papers?\s+that\s+cite", r"work\s+citing", r"research\s+citing", r"studies?\s+citing",
        r"articles?\s+citing", r"works?\s+that\s+cite", r"papers?\s+which\s+cite", r"show\s+citations?", r"list\s+citations?",
    ],
    "similar": [
        r"similar\s+to\s+this\s+paper", r"similar\s+papers?\s+to", r"papers?\s+like", r"papers?\s+similar\s+to",
        r"find\s+similar", r"related\s+to", r"related\s+papers?", r"work\s+similar\s+to", r"studies?\s+resembling",
        r"resembles?", r"resembling", r"papers?\s+resembling", r"works?\s+like", r"articles?\s+like", r"studies?\s+like",
        r"similar\s+work", r"similar\s+research", r"similar\s+studies?", r"comparable\s+papers?", r"comparable\s+work",
    ],
    "trending": [
        r"trending\s+papers?", r"what'?s?\s+hot", r"popular\s+papers?", r"trending\s+(in|on|about)", r"currently\s+popular",
        r"hot\s+topics?", r"hot\s+papers?", r"what'?s?\s+trending", r"trending\s+research", r"trending\s+topics?",
        r"popular\s+research", r"popular\s+now", r"popular\s+recently", r"recently\s+popular", r"hot\s+research", r"hot\s+in",
        r"trending\s+now", r"hot\s+topics?\s+in",
    ],
    "useful": [
        r"most\s+useful", r"useful\s+papers?", r"high\s+utility", r"high-utility", r"helpful\s+papers?", r"helpful\s+research",
        r"helpful\s+work", r"foundational\s+work", r"foundational\s+papers?", r"essential\s+reading", r"essential\s+papers?",
        r"must[\s-]?read\s+papers?", r"must[\s-]?read", r"key\s+papers?", r"key\s+references?", r"important\s+papers?",
        r"seminal\s+papers?", r"seminal\s+work", r"landmark\s+papers?",
    ],
    "reviews": [
        r"review\s+articles?\s+(on|about|of)", r"reviews?\s+of", r"find\s+reviews?", r"review\s+papers?\s+(on|about|of)",
        r"survey\s+papers?", r"survey\s+articles?", r"overviews?\s+of", r"overview\s+papers?", r"comprehensive\s+reviews?",
        r"comprehensive\s+survey", r"survey\s+(on|about|of)", r"reviews?\s+(on|about)", r"state[\s-]?of[\s-]?the[\s-]?art\s+review",
        r"literature\s+review", r"review\s+of\s+the\s+literature", r"systematic\s+review", r"tutorial\s+(on|about)",
        r"tutorial\s+papers?", r"introduction\s+to",
    ],
}

# Year phrases, tried in this order, and what the numbers mean.
YEAR_PHRASES = [
    (r"\bfrom\s+(\d{4})\s+to\s+(\d{4})\b", "range"),
    (r"\bbetween\s+(\d{4})\s+and\s+(\d{4})\b", "range"),
    (r"\b(\d{4})\s*[-–—]\s*(\d{4})\b", "range"),
    (r"\bsince\s+(\d{4})\b", "since"),
    (r"\bafter\s+(\d{4})\b", "after"),
    (r"\bfrom\s+(\d{4})\b", "since"),
    (r"\bbefore\s+(\d{4})\b", "before"),
    (r"\buntil\s+(\d{4})\b", "until"),
    (r"\bthrough\s+(\d{4})\b", "until"),
    (r"\b(?:last|past)\s+(\d+)\s+years?\b", "last_n"),
    (r"\bin\s+(\d{4})\b", "exact"),
    (r"\bin\s+the\s+(\d{4})s\b", "decade"),
    (r"\bthe\s+(\d{4})s\b", "decade"),
]

AUTHOR_PHRASES = [
    r"\bby\s+([A-Z][a-z]+)(?:\s+([A-Z]\.?))?\b",
    r"\bauthors?\s*:?\s+([A-Z][a-z]+)(?:\s+([A-Z]\.?))?\b",
    r"\bfirst[-\s]?author\s+([A-Z][a-z]+)(?:\s+([A-Z]\.?))?\b",
    r"\b([A-Z][a-z]+)\s+et\s+al\.?\b",
]

# Text with one of these is a query already.
QUERY_MARKS = (
    "author: abs: title: pubdate: bibstem: doctype: property: collection: bibgroup: object: aff: "
    "citations( references( trending( useful( similar( reviews("
).split()

# Field marks that natural language must not have.
NL_MARKS = (
    "author abs abstract title pubdate bibstem object keyword doi arXiv orcid aff inst citation_count property "
    "collection doctype full body"
).split()
