"""Parameters the queries and their SQL counterparts share."""

from __future__ import annotations

from voilage.config import Roles, Settings

CHECK_SEED = "check"
STRICT = Settings(noise_seed=CHECK_SEED)
THRESHOLDS = (20000, 50000.5, 40000, 80000)
WORD_BREAK = "[^A-Za-zÀ-ÿ0-9]+"
# the same set, character by character: Java looks single ones below 256 up in a table, and tests ranges one after the other
WORD_BREAK_LISTED = "[^" + "".join(chr(c) for a, b in ("09", "AZ", "az", "Àÿ") for c in range(ord(a), ord(b) + 1)) + "]+"
NAME_PREFIXES = (
    "", "id_", "Date_Naissance_", "code_postal_", "revenu_", "type_compte_", "email_", "solde_",
    "ville_", "diagnostic_", "assurance_", "date_maj_", "texte_", "téléphone_", "nom_", "iban_",
)
ACCOUNT_ROLES = Roles(sensitive="statut", qids=("type_compte",))
BAR_ROLES = Roles(
    postal="code_postal", date2="date_naissance", revenue="revenu_annuel",
    qids=("statut", "code_postal", "date_naissance", "revenu_annuel"),
)
