"""Text expressions: tokenizer (F19), n-grams, keyword role tags (F15), token counts (F16).

The tokenizer is one regex evaluated in the JVM.  ``(?U)`` makes ``\\w`` and ``\\b``
Unicode-aware (T17); without it accented words lose letters.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values (must equal the reference's for right results) --------------------
# Word tokens: runs of two or more word characters, lower-cased text, Unicode classes.
TOKEN_PATTERN = r"(?U)\b\w\w+\b"
# Keyword roles; a text gets every role with at least one keyword contained in it
# (both sides lower-cased); no role -> "None detected".
ROLE_KEYWORDS = {
    "UI": ["streamlit", "dash", "flask", "django", "gradio", "altair", "plotly", "seaborn", "matplotlib",
           "pydeck"],
    "Model Loading": ["transformers", "AutoModel", "BertModel", "SentenceTransformer", "from_pretrained",
                      "pipeline"],
    "NLP Processing": ["tokenize", "lemmatize", "stem", "stopwords", "regex", "preprocess", "embedding"],
    "LLM Integration": ["openai", "ChatCompletion", "Embedding", "google-generativeai",
                        "google-ai-generativelanguage"],
    "ML Training": ["fit(", "predict(", "LogisticRegression", "KMeans", "train_test_split", "scikit-learn",
                    "imbalanced-learn"],
    "Database": ["pymongo", "MongoClient", "insert_one", "find(", "update_one", "delete_one", "hf-xet",
                 "pyarrow"],
    "Monitoring/Logging": ["logging", "log_event", "logger", "watchdog", "rich"],
    "Evaluation": ["precision", "recall", "f1_score", "silhouette_score", "classification_report"],
    "Deployment": ["Werkzeug", "Flask", "gunicorn"],
    "Notifications/Email": ["yagmail", "premailer"],
    "Testing/QA": ["pytest", "unittest", "flake8", "autopep8"],
}
NO_ROLE = "None detected"
# ---------------------------------------------------------------------------------------


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def tokens(text) -> Column:
    """lower-cased word tokens, in order (array<string>)."""
    return F.regexp_extract_all(F.lower(_c(text)), F.lit(TOKEN_PATTERN), 0)


def token_count(text) -> Column:
    """Number of word tokens (no array is materialised)."""
    return F.regexp_count(_c(text), F.lit(TOKEN_PATTERN))


def bigrams(toks) -> Column:
    """Adjacent token pairs joined by one space (the 2-gram half of ngram_range=(1,2))."""
    t = _c(toks)
    return F.zip_with(F.slice(t, 1, F.greatest(F.size(t) - 1, F.lit(0))),
                      F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(0))),
                      lambda a, b: F.concat_ws(" ", a, b))


def uni_and_bigrams(text) -> Column:
    t = tokens(text)
    return F.concat(t, bigrams(t))


def whitespace_tokens(text) -> Column:
    """Lower-cased text split on runs of whitespace, empties removed; the token form of
    the substring pre-join (both sides must use this same split)."""
    parts = F.split(F.lower(_c(text)), r"[ \t\n\x0B\f\r]+")
    return F.array_remove(parts, "")


def role_tags(text) -> Column:
    """sorted array of roles whose keywords occur in the text, or [NO_ROLE]."""
    low = F.lower(_c(text))
    hits = []
    for role, kws in ROLE_KEYWORDS.items():
        cond = None
        for k in kws:
            c = F.contains(low, F.lit(k.lower()))
            cond = c if cond is None else (cond | c)
        hits.append(F.when(cond, F.lit(role)))
    arr = F.array_compact(F.array(*hits))
    return F.when(F.size(arr) == 0, F.array(F.lit(NO_ROLE))).otherwise(F.array_sort(arr))


def over_length(text, max_tokens: int = 512) -> Column:
    """F16: would the text be truncated at ``max_tokens`` word tokens?"""
    return token_count(text) > max_tokens
