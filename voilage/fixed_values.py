"""Values that define the expected results: patterns, labels, word lists.

Nothing here is computed. Everything below is a fixed value: changing one
changes what a job returns.
"""

# --- fixed values: text classes -------------------------------------------

# White space as ECMAScript's \s defines it (Java's \s lacks most of these).
BLANKS = (
    "\t\n\x0b\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
LINE_ENDS = "\\n\\r\\u2028\\u2029"
RARE_LINE_ENDS = "\\r\\u2028\\u2029"
YEAR = "(?<![A-Za-z0-9_])((?:19|20)[0-9]{2})(?![A-Za-z0-9_])"
BYTE_ORDER_MARK = "\ufeff"
DELIMITERS = (",", ";", "\t")
HEADER_CELL = "[A-Za-z_]"
DEFAULT_SALT = "change-me-salt"

# --- fixed values: generalization labels ----------------------------------

INCOME_STEP = 10000
INCOME_BANDS = ((40000, "<40k"), (60000, "40-60k"), (80000, "60-80k"))
TOP_INCOME_BAND = ">=80k"
NOISE_SENSITIVITY = 500.0

# --- fixed values: column-name patterns (applied to lower-cased names) -----

ROLE_PATTERNS = {
    "id": "(^|_)(id|ident|client|no[_-]?client|numero[_-]?client)($|_)",
    "postal": "postal|code[_-]?postal|zip|fsa",
    "date1": "date.*(naiss|birth|ouv|open|transaction|op[eé]ration)|^date$",
    "date2": "date.*(op[eé]ration|transaction|maj|update|modif)",
    "revenue": "revenu|salaire|income|montant|amount|solde",
    "sensitive": "type.*(compte|assurance|produit|segment)|diagnostic|statut|risk",
}

IDENTIFIER = "(^|_)id($|_)|ident|client|ssn|nas"
CONTACT = "email|courriel|phone|tel|tél"
DIRECT_PII = "^id$|(^|_)id($|_)|ident|client|ssn|nas|email|courriel|phone|tel|tél"
MASKED_CONTACT = "email|e-mail|courriel|phone|tél|telephone"
POSTAL = "postal|code[_-]?postal|zip|fsa"
MONEY = "revenu|salaire|income|montant|amount|solde|balance"

TYPE_RULES = (
    (IDENTIFIER + "|" + CONTACT, "Identifiant"),
    ("date", "Date"),
    (POSTAL + "|ville|adresse", "Géoloc"),
    (MONEY, "Numérique"),
)
TYPE_DEFAULT = "Texte"

CATEGORY_RULES = (
    (MONEY + "|iban|bic|numero[_-]?compte|carte[_-]?credit", "Finance"),
    ("sant[eé]|m[eé]dical|diagnostic|pathologie|maladie|allergie|mutuelle", "Santé"),
    ("assur|police[_-]?assurance|sinistre", "Assurance"),
)
CATEGORY_DEFAULT = "Renseignements personnels"

PERSONAL = IDENTIFIER + "|" + CONTACT + "|date|" + POSTAL + "|nom|pr[eé]nom|adresse|ville"

RISK_RULES = (
    (IDENTIFIER, 92),
    (CONTACT, 88),
    ("date", 78),
    (POSTAL, 61),
    (MONEY + "|carte[_-]?credit", 69),
)
RISK_DEFAULT = 20
RISK_BUCKETS = ((70, "Élevé"), (40, "Moyen"))
RISK_BUCKET_DEFAULT = "Faible"

RECOMMENDATION_RULES = (
    ("email|courriel", "mask", None),
    ("phone|tel|tél", "mask", None),
    ("date", "generalize", "date-year"),
    ("postal|zip|fsa", "generalize", "postal-fsa"),
    ("revenu|salaire|income|montant|amount", "noise", None),
    ("nom|prenom|prénom|ville|adresse|text|note", "mask", None),
)
RECOMMENDED_NOISE_BETA = 5

# (pattern, points) taken off a column's risk when the matching switch is on
REDUCTION_IDS = ("(^|_)id($|_)|ident|client|ssn|nas|email|phone|tel", 40)
REDUCTION_DATES = ("date", 20)
REDUCTION_POSTAL = ("code[_-]?postal|postal|zip|fsa", 15)
REDUCTION_MONEY = "revenu|salaire|income|montant|amount|solde"
REDUCTION_MONEY_BY_EPSILON = ((3, 10), (5, 5))
REDUCTION_MAX = 50

# --- fixed values: compliance thresholds and verdicts ----------------------

COMPLIANCE_THRESHOLDS = (("individualization", 20), ("correlation", 30), ("inference", 35))
VERDICT_UNKNOWN = "N/A"
VERDICT_OK = "Conforme"
VERDICT_BAD = "À améliorer"

# --- fixed values: synthetic client table ----------------------------------

CLIENT_COLUMNS = (
    "id_client", "prenom", "nom", "email", "telephone", "adresse",
    "ville", "province", "code_postal", "date_naissance", "revenu_annuel",
)
CLIENT_SEED = 42
FIRST_NAMES = (
    "Nora", "Emma", "Léa", "Olivia", "Mila", "Élise", "Liam", "William", "Noah", "Thomas",
    "Raphaël", "Émile", "Zoe", "Ava", "Élodie", "Antoine", "Mathis", "Jacob", "Ethan", "Adam",
)
LAST_NAMES = (
    "Tremblay", "Gagnon", "Roy", "Côté", "Bouchard", "Gauthier", "Morin", "Lavoie", "Fortin", "Gagné",
    "Ouellet", "Pelletier", "Bélanger", "Lefebvre", "Martel", "Richard", "Poirier", "Deschamps",
    "Boucher", "Carpentier",
)
STREETS = (
    "St-Denis", "Sherbrooke", "Ste-Catherine", "Papineau", "Mont-Royal", "Laurier", "Bourassa", "Masson",
    "Viau", "Belmont", "Victoria", "King", "Main", "St-Jean", "Grande-Allée", "Cartier", "Racine",
    "Frontenac", "Dollard", "Beaubien",
)
STREET_TYPES = ("Rue", "Avenue", "Boulevard", "Chemin", "Place")
CITIES = (
    "Montréal", "Québec", "Laval", "Gatineau", "Longueuil", "Sherbrooke", "Saguenay", "Lévis",
    "Trois-Rivières", "Terrebonne", "Brossard", "Repentigny", "Drummondville", "Saint-Jérôme", "Granby",
    "Blainville", "Saint-Jean-sur-Richelieu", "Shawinigan", "Chicoutimi", "Rimouski",
)
AREA_CODES = (514, 438, 450, 579, 581, 418, 819, 873, 367)
POSTAL_REGIONS = ("G", "H", "J")
POSTAL_LETTERS = "ABCEGHJKLMNPRSTVXY"
PROVINCE = "QC"
MAIL_DOMAIN = "bnc.example"
BIRTH_YEARS = (1940, 2005)
# (upper bound of the first uniform draw, lowest income, highest income)
INCOME_MIX = (
    (0.25, 22000, 39999),
    (0.55, 40000, 59999),
    (0.85, 60000, 79999),
    (0.97, 80000, 119999),
    (1.00, 120000, 200000),
)
