"""Names, texts, word lists and limits that results depend on."""

from __future__ import annotations

# Plain names of feature columns.
GLOSSARY = {
    "amt_log": "transaction amount",
    "TransactionAmt": "transaction amount",
    "amt_cents": "the cents portion of the amount",
    "amt_is_round": "a round-number amount",
    "hour": "the hour of day",
    "is_night": "an overnight transaction",
    "dayofweek": "the day of week",
    "n_missing": "the amount of missing data on this record",
    "ProductCD": "the product type",
    "card4": "the card network",
    "card6": "the card type (debit/credit)",
    "card1_freq": "how common this card identifier is",
    "card2_freq": "how common this card group is",
    "addr1_freq": "how common this billing region is",
    "P_emaildomain": "the payer email domain",
    "P_emaildomain_freq": "how common the payer email domain is",
    "R_emaildomain": "the recipient email domain",
    "email_domains_match": "whether payer and recipient email domains match",
    "DeviceType": "the device type",
    "DeviceInfo_freq": "how common this device is",
    "id_31": "the browser",
    "id_31_freq": "how common this browser is",
    "dist1": "the distance between billing and transaction location",
    "dist2": "a secondary distance measure",
    "D15": "days since a prior related transaction",
    "D1": "days since the card was first seen",
    "C1": "a count of related addresses",
    "C13": "a count of related payment activity",
    "C14": "a count of distinct related entities",
}

# Action and owner per risk band.
BAND_ACTIONS = {
    "CRITICAL": ("decline and contact the cardholder immediately", "Fraud Operations"),
    "HIGH": ("hold for manual review within the hour", "Fraud Operations"),
    "MEDIUM": ("queue for same-day analyst review", "Fraud Operations"),
    "LOW": ("monitor; no action unless a further alert fires", "Automated"),
    "MINIMAL": ("approve", "Automated"),
}

# Phrases of a narrative.
DISCLAIMER = "[machine-generated from model output; not an analyst write-up]"
DRIVER_PHRASE = "The model raised this alert primarily because of "
MITIGATOR_PHRASE = "Reducing the score: "
ACTION_PHRASE = "Recommended action: "

# Groundedness word lists, limits and verdicts.
STOP_WORDS = (
    "the", "a", "an", "and", "or", "of", "to", "in", "is", "are", "for",
    "on", "with", "that", "this", "be", "must", "not", "it", "as", "by",
    "from", "at", "which", "where", "any", "may", "was", "were", "has",
)
REFUSAL_MARKERS = (
    "does not cover this",
    "not covered by the provided",
    "cannot answer from the provided",
)
REFUSAL_LENGTH = 200
GROUNDED_VERDICTS = (
    (0.75, "well grounded"),
    (0.55, "partially grounded - review"),
    (0.0, "POSSIBLE HALLUCINATION - most content words are absent from the retrieved context"),
)
CORRECT_REFUSAL = (
    "correct refusal - the model declined to answer outside the retrieved context, which is the desired safety behaviour"
)
EMPTY_ANSWER = "empty answer"
OVERLAP_METHOD = "lexical overlap heuristic, not an LLM judge"
REFUSAL_METHOD = "refusal detected; overlap scoring skipped"

# Limit and verdicts of the leakage audit.
LEAKAGE_LIMIT = 0.35
LEAKAGE_SUSPECT = "LEAKAGE SUSPECT - one feature dominates; verify it is knowable at prediction time"
LEAKAGE_HEALTHY = (
    "healthy - importance is spread across many features, which is what genuine fraud signal looks like"
)
LEAKAGE_NOTHING = "no signal"

# Chunk size and overlap in words.
CHUNK_WORDS = 180
CHUNK_OVERLAP = 40

# Text of a retrieval prompt and of similarity queries.
PROMPT_HEAD = "POLICY CONTEXT\n==============\n"
PROMPT_TASK = (
    "\n\n==============\n"
    "Using ONLY the policy context above, answer this question.\n"
    "Cite the source file for each claim. If the context does not contain\n"
    'the answer, say "The provided policy does not cover this."\n\n'
    "QUESTION: "
)
SIMILAR_PHRASE = "fraud alert driven by "
SIMILAR_FALLBACK = "high risk fraud alert"
POLICY_QUESTION = ("What are the review requirements and evidence standards for a ", " risk transaction?")
