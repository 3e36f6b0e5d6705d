"""Masks for personal and payment data in text that is stored with traces."""

# (name, pattern, replacement). They run in this order, on the text left by
# the one before: an IBAN holds digit runs a phone pattern would take.
# The patterns avoid look-around so that other SQL engines accept them too.
MASKS = (
    ("email", r"\b[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "<email>"),
    ("iban", r"\b[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){3,7}(?: ?[0-9A-Z]{1,3})?\b", "<iban>"),
    ("vat_id", r"\bDE[0-9]{6,12}\b", "<vat_id>"),
    ("phone", r"\+[0-9]{1,3} ?\(?[0-9]{2,5}\)?[ /-]?[0-9]{3,5}(?:[ -]?[0-9]{2,5})?", "<phone>"),
)
