"""Fixed values the computations depend on.

FIXED VALUES (must stay as written for results to match):
- ranking-feature parameters: BM25 feature k1 = 2.5, b = 0.8; Dirichlet mu = 50;
  Jelinek-Mercer lambda = 0.5; absolute discount delta = 0.5.
- retrieval BM25 (our documented default): k1 = 1.2, b = 0.75,
  idf = ln(1 + (N - df + 0.5) / (df + 0.5)).
- text limit 15000 characters; 10 negatives per query; seed 42;
  split rates 0.70 / 0.15 / 0.15 (as DOUBLE); NDCG/ERR cut-off 10;
  MAP relevance threshold 1; 13 topic classes.
- ARI: 4.71 * chars/words + 0.5 * words/sentences - 21.43.
- punctuation characters: !"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~
"""

# FIXED VALUES: stop words, a short list shared by the Spark code and the
# DuckDB oracle (callers may pass their own table).
STOP_WORDS = [
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "from",
    "had", "has", "have", "he", "her", "his", "i", "in", "is", "it", "its",
    "not", "of", "on", "or", "she", "that", "the", "their", "they", "this",
    "to", "was", "were", "which", "will", "with", "you",
]

# FIXED VALUES: public-suffix entries used with the driver's pages.
DEFAULT_PUBLIC_SUFFIXES = ["com", "net", "org", "co.uk"]

PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

TEXT_LENGTH_LIMIT = 15000
NEGATIVE_COUNT = 10
SEED = 42
TRAIN_RATE = 0.7
VALID_RATE = 0.15
CUTOFF = 10
MAP_REL_THRESHOLD = 1
N_TOPICS = 13

QD_BM25_K1 = 2.5
QD_BM25_B = 0.8
LM_DIR_MU = 50.0
LM_JM_LAMBDA = 0.5
LM_ABS_DELTA = 0.5

RETRIEVAL_K1 = 1.2
RETRIEVAL_B = 0.75

# Names of the 15 query-document features, in vector order.
QD_FEATURE_NAMES = [
    "tf_sum", "log_tf_sum", "norm_tf_sum", "log_norm_tf_sum", "idf_sum",
    "log_idf_sum", "icf_sum", "log_tfidf_sum", "tfidf_sum", "tf_icf_sum",
    "bm25", "log_bm25", "lm_dir", "lm_jm", "lm_abs",
]
Q_FEATURE_NAMES = [
    "query_length", "idf_sum", "idf_mean", "idf_max", "idf_sd", "icf_sum", "icf_mean",
]


def feature_index(n_topics: int = N_TOPICS) -> dict[str, list[int]]:
    """Index lists into the assembled vector, derived from the class count:
    Q block, D block (6 leading, topics, 3 trailing), Q-D block (title, text)."""
    n_q = len(Q_FEATURE_NAMES)
    n_d = 6 + n_topics + 3
    n_qd = 2 * len(QD_FEATURE_NAMES)
    q = list(range(0, n_q))
    d = list(range(n_q, n_q + n_d))
    qd = list(range(n_q + n_d, n_q + n_d + n_qd))
    ltr = d[:4] + d[-3:] + qd
    return {"Q": q, "D": d, "Q-D": qd, "LtR": ltr, "ALL": q + d + qd}
