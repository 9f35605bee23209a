"""Word lists of the name and address normaliser, and the folding table."""

from __future__ import annotations

import sys
import unicodedata

# Results depend on exactly these words.
# Legal suffixes dropped from names.
SUFFIXES = (
    "inc", "incorporated", "llc", "ltd", "limited", "pvt", "private", "llp",
    "corp", "corporation", "co", "company", "plc", "lp", "pc", "pllc",
    "sarl", "sas", "sasu", "eurl", "sa", "sci", "snc", "ei", "gmbh", "bv",
)
# Words without identity dropped from names.
NOISE_WORDS = (
    "the", "and", "of", "dba", "ta", "formerly", "known", "as", "aka",
    "services", "service", "center", "centre", "partners", "partner",
    "group", "holdings", "holding", "smt", "m/s", "ms", "mr", "mrs",
)
# Words that do not distinguish addresses.
ADDR_STOP = (
    "street", "st", "road", "rd", "avenue", "ave", "av", "boulevard", "blvd",
    "drive", "dr", "lane", "ln", "court", "ct", "place", "pl", "way",
    "highway", "hwy", "parkway", "pkwy", "circle", "cir", "trail", "trl",
    "terrace", "ter", "square", "sq", "alley", "aly", "floor", "fl", "unit",
    "apt", "apartment", "suite", "ste", "building", "bldg", "no", "number",
    "near", "nr", "opp", "opposite", "behind", "beside", "po", "box", "pmb",
    "hn", "hno", "plot", "flat", "gala", "ward", "block", "sector", "phase",
    "main", "cross", "nagar", "colony", "marg",
    "rue", "allee", "quai", "impasse", "imp", "bis", "chemin", "route",
    "cours", "passage", "residence",
)
# Regions and cities written in more than one way.
REGION = {
    "alabama": "al", "alaska": "ak", "arizona": "az", "arkansas": "ar",
    "california": "ca", "colorado": "co", "connecticut": "ct", "delaware": "de",
    "florida": "fl", "georgia": "ga", "hawaii": "hi", "idaho": "id",
    "illinois": "il", "indiana": "in", "iowa": "ia", "kansas": "ks",
    "kentucky": "ky", "louisiana": "la", "maine": "me", "maryland": "md",
    "massachusetts": "ma", "michigan": "mi", "minnesota": "mn",
    "mississippi": "ms", "missouri": "mo", "montana": "mt", "nebraska": "ne",
    "nevada": "nv", "hampshire": "nh", "jersey": "nj", "mexico": "nm",
    "york": "ny", "carolina": "nc", "dakota": "nd", "ohio": "oh",
    "oklahoma": "ok", "oregon": "or", "pennsylvania": "pa", "rhode": "ri",
    "tennessee": "tn", "texas": "tx", "utah": "ut", "vermont": "vt",
    "virginia": "va", "washington": "wa", "wisconsin": "wi", "wyoming": "wy",
    "maharashtra": "mh", "karnataka": "ka", "tamilnadu": "tn", "kerala": "kl",
    "keralam": "kl", "delhi": "dl", "gujarat": "gj", "rajasthan": "rj",
    "telangana": "ts", "andhrapradesh": "ap", "uttarpradesh": "up",
    "westbengal": "wb", "madhyapradesh": "mp", "punjab": "pb", "bihar": "br",
    "haryana": "hr", "odisha": "or", "jharkhand": "jh", "assam": "as",
    "uttarakhand": "uk", "chhattisgarh": "cg", "goa": "ga",
    "bombay": "mumbai", "calcutta": "kolkata", "madras": "chennai",
    "bangalore": "bengaluru", "poona": "pune",
}
# Weights, bias and threshold of the linear scorer used without a trained model, for the first 15 features.
LINEAR_WEIGHTS = (2.0, 1.0, 2.5, 2.5, 1.0, 2.5, 0.5, 1.0, 0.5, 2.0, 2.0, 2.0, 2.0, 1.0, 1.0)
LINEAR_BIAS = -4.5
LINEAR_THRESHOLD = 0.0
# End of the fixed values.

_MARKS = "".join(map(chr, range(0x0300, 0x0370)))
#: Ranges whose characters with longer decompositions are common: they have replacements of their own.
_LONG = (range(0x80, 0x250), range(0x1E00, 0x1F00), range(0xFB00, 0xFB07))


def fold_table() -> tuple[str, str, dict[str, str], dict[str, str]]:
    """``translate`` arguments that map single characters to their decomposed, unmarked, lower-case ASCII form and
    delete combining marks, and replacements for common and for rare characters with longer forms.

    Derived from the Unicode data: characters whose form has no ASCII letter or digit are separators either way.
    """
    source, target, common, rare = [], [], {}, {}
    for code in range(0x80, sys.maxunicode + 1):
        c = chr(code)
        form = unicodedata.normalize("NFKD", c)
        if form == c:
            continue
        form = "".join(x for x in form if x not in _MARKS).lower()
        if len(form) == 1 and form.isascii():
            source.append(c)
            target.append(form)
        elif any(x.isascii() and x.isalnum() for x in form):
            (common if any(code in r for r in _LONG) else rare)[c] = form
    return "".join(source) + _MARKS, "".join(target), common, rare


def ranges(chars, gap: int = 64) -> str:
    """Few ranges of a regular expression class that cover ``chars``, and what lies between near ones."""
    found: list[list[int]] = []
    for code in sorted(map(ord, chars)):
        if found and code - found[-1][1] <= gap:
            found[-1][1] = code
        else:
            found.append([code, code])
    return "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in found)


FOLD_FROM, FOLD_TO, FOLD_LONG, FOLD_RARE = fold_table()
