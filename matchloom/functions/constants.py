"""Fixed values shared by normalization: postal codes of states and territories."""

from __future__ import annotations

# Names of states and territories, and their postal codes.
STATE_CODES = {
    "ALABAMA": "AL", "ALASKA": "AK", "ARIZONA": "AZ", "ARKANSAS": "AR", "CALIFORNIA": "CA", "COLORADO": "CO", "CONNECTICUT": "CT",
    "DELAWARE": "DE", "FLORIDA": "FL", "GEORGIA": "GA", "HAWAII": "HI", "IDAHO": "ID", "ILLINOIS": "IL", "INDIANA": "IN", "IOWA": "IA",
    "KANSAS": "KS", "KENTUCKY": "KY", "LOUISIANA": "LA", "MAINE": "ME", "MARYLAND": "MD", "MASSACHUSETTS": "MA", "MICHIGAN": "MI",
    "MINNESOTA": "MN", "MISSISSIPPI": "MS", "MISSOURI": "MO", "MONTANA": "MT", "NEBRASKA": "NE", "NEVADA": "NV", "NEW HAMPSHIRE": "NH",
    "NEW JERSEY": "NJ", "NEW MEXICO": "NM", "NEW YORK": "NY", "NORTH CAROLINA": "NC", "NORTH DAKOTA": "ND", "OHIO": "OH", "OKLAHOMA": "OK",
    "OREGON": "OR", "PENNSYLVANIA": "PA", "RHODE ISLAND": "RI", "SOUTH CAROLINA": "SC", "SOUTH DAKOTA": "SD", "TENNESSEE": "TN",
    "TEXAS": "TX", "UTAH": "UT", "VERMONT": "VT", "VIRGINIA": "VA", "WASHINGTON": "WA", "WEST VIRGINIA": "WV", "WISCONSIN": "WI",
    "WYOMING": "WY", "DISTRICT OF COLUMBIA": "DC", "PUERTO RICO": "PR", "GUAM": "GU", "VIRGIN ISLANDS": "VI", "U S VIRGIN ISLANDS": "VI",
    "AMERICAN SAMOA": "AS", "NORTHERN MARIANA ISLANDS": "MP",
}

# Legal forms at the end of names, and the form that stands for each group of synonyms.
LEGAL_SUFFIXES = [
    "INCORPORATED", "INC", "CORPORATION", "CORP", "COMPANY", "CO", "LIMITED", "LTD", "LLC", "LLP", "LP", "PC", "PLLC", "ASSOCIATION", "ASSN",
    "ASSOC", "FOUNDATION", "FDN", "FUND", "TRUST", "SOCIETY", "INSTITUTE", "ORGANIZATION", "ORG",
]
CANONICAL_FORMS = {"INCORPORATED": "INC", "CORPORATION": "CORP", "COMPANY": "CO", "LIMITED": "LTD", "ASSOCIATION": "ASSN", "ASSOC": "ASSN", "FDN": "FOUNDATION", "ORGANIZATION": "ORG"}
# Abbreviations in names.
ABBREVIATIONS = {
    "ASSOC": "ASSOCIATION", "ASSN": "ASSOCIATION", "NATL": "NATIONAL", "NAT": "NATIONAL", "INTL": "INTERNATIONAL", "INTERNATL": "INTERNATIONAL",
    "DEPT": "DEPARTMENT", "UNIV": "UNIVERSITY", "COMM": "COMMUNITY", "CTR": "CENTER", "SVCS": "SERVICES", "SVC": "SERVICE", "AMER": "AMERICAN",
    "MT": "MOUNT", "ST": "SAINT",
}
# Street words and their postal short forms, and the short forms that end a street.
STREET_WORDS = {
    "STREET": "ST", "AVENUE": "AVE", "BOULEVARD": "BLVD", "ROAD": "RD", "DRIVE": "DR", "LANE": "LN", "COURT": "CT", "PLACE": "PL", "SQUARE": "SQ",
    "HIGHWAY": "HWY", "PARKWAY": "PKWY", "CIRCLE": "CIR", "TERRACE": "TER", "TRAIL": "TRL", "SUITE": "STE", "APARTMENT": "APT", "BUILDING": "BLDG",
    "FLOOR": "FL", "NORTH": "N", "SOUTH": "S", "EAST": "E", "WEST": "W",
}
STREET_TYPES = [
    "ST", "AVE", "BLVD", "RD", "DR", "LN", "CT", "PL", "SQ", "HWY", "PKWY", "CIR", "TER", "TRL", "WAY", "PLZ", "LOOP", "PATH", "PIKE", "RUN", "ROW",
    "XING", "EXPY", "FWY", "TPKE", "ALY", "BND", "BR", "BRG", "CYN", "CV", "CRK", "EST", "GDNS", "GLN", "GRN", "HTS", "HL", "HOLW", "JCT", "KNL", "LK",
    "MNR", "MDWS", "PT", "RDG", "SPG", "SPGS", "TRCE", "VLY", "VW", "VIS", "WALK", "CTR", "XRD", "PASS", "CRES", "GTWY", "LNDG", "MALL", "PARK", "CMN",
    "CMNS", "BLF",
]
# Generations, ordinals and directions in names.
GENERATIONS = {"JR": "2", "SR": "1"}
ORDINAL_RANKS = {
    "FIRST": "1", "1ST": "1", "SECOND": "2", "2ND": "2", "THIRD": "3", "3RD": "3", "FOURTH": "4", "4TH": "4", "FIFTH": "5", "5TH": "5", "SIXTH": "6",
    "6TH": "6", "SEVENTH": "7", "7TH": "7", "EIGHTH": "8", "8TH": "8", "NINTH": "9", "9TH": "9", "TENTH": "10", "10TH": "10",
}
NAME_DIRECTIONS = {"NORTH": "N", "SOUTH": "S", "EAST": "E", "WEST": "W", "NORTHEAST": "NE", "NORTHWEST": "NW", "SOUTHEAST": "SE", "SOUTHWEST": "SW"}
# Tokens that say nothing in a name.
STOPWORDS = [
    "INC", "INCORPORATED", "CORP", "CORPORATION", "CO", "COMPANY", "LLC", "LTD", "LP", "LLP", "PC", "PLLC", "LIMITED", "THE", "AND", "OF", "FOR", "A",
    "AN", "IN", "TO", "AT", "FOUNDATION", "FUND", "TRUST", "ASSOCIATION", "ASSN", "ORGANIZATION", "ORG",
]
# Short and popular names of cities.
CITY_ALIASES = {
    "NYC": "NEW YORK CITY", "NY CITY": "NEW YORK CITY", "NEW YORK": "NEW YORK CITY", "LA": "LOS ANGELES", "L A": "LOS ANGELES", "SF": "SAN FRANCISCO",
    "PHILLY": "PHILADELPHIA", "ST LOUIS": "SAINT LOUIS", "ST PAUL": "SAINT PAUL", "FT WORTH": "FORT WORTH", "FT LAUDERDALE": "FORT LAUDERDALE",
    "MT PLEASANT": "MOUNT PLEASANT",
}
# Units and post office boxes in street lines.
UNIT_PATTERN = r"(STE|SUITE|APT|APARTMENT|UNIT|#|BLDG|RM|ROOM)\s*#?\s*[0-9A-Z]+"
UNIT_DROPPED = r"(STE|SUITE|APT|APARTMENT|UNIT|BLDG|RM|ROOM)\s+[0-9A-Z]+"
BOX_PATTERN = r"^(P ?O ?BOX|P ?O ?B|BOX|P ?O) ?#? ?[0-9]+"
# Words of rules that tell organisations apart.
AFFILIATES = ["FOUNDATION", "ENDOWMENT", "AUXILIARY", "BOOSTERS", "BOOSTER"]
FORPROFIT_PATTERN = r" (LLC|L L C|LP|L P|LLP|PLLC|LLLP)$| LIMITED PARTNERSHIP$"
GOVERNMENT_PATTERN = (
    r"^(THE )?(CITY|COUNTY|TOWN|VILLAGE|TOWNSHIP|BOROUGH) OF |HOUSING AUTHORITY|REDEVELOPMENT AUTHORITY|SCHOOL DISTRICT|BOARD OF EDUCATION|PUBLIC LIBRARY"
    r"|COUNCIL OF GOVERNMENTS|JOINT POWERS|(WATER|SEWER|SEWERAGE|SANITATION|SANITARY|IRRIGATION|RECLAMATION|FIRE|UTILITY|DRAINAGE|CONSERVANCY|IMPROVEMENT|METROPOLITAN) DISTRICT"
)
