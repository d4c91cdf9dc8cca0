"""Quality rules as a bitmask ledger: measure once, store failure bits, decide later.

Every rule is evaluated once per document. The ledger keeps the measurements and one bit
per failed rule; a policy is a versioned mask over these bits, so verdicts of any policy and
the ablation of any rule are bit operations on the ledger and never read a text again.

Defined results: a null or empty text has no words, all measurements 0, and fails
``few_words``. A null ``doc_id`` is kept as it is. Repeated rows give repeated ledger rows.
An empty table gives an empty ledger. Further input columns are ignored by ``ledger`` and
kept by ``with_ledger`` unless a ledger column has the same name (then the ledger wins).
Long texts are measured whole: three-word windows are hashed to 64 bits and sorted, so the
work is n log n in the words of one text.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_WORDS = 50
WINDOW = 3

#: Rule name to SQL over the measurements (true: failed); the position is the bit.
RULES = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "100 * n_symbols > 30 * n_words",
    "repeated_lines": "100 * n_dup_lines > 50 * n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 20 * n_words",
}
BIT = {name: 1 << i for i, name in enumerate(RULES)}
BASE_MASK = BIT["few_words"] | BIT["repeated_words"]

#: Policy version to the mask of rules that reject.
POLICIES = {
    "base": BASE_MASK,
    "v1": BASE_MASK | BIT["symbols"] | BIT["repeated_lines"],
    "v2": BASE_MASK | BIT["symbols"] | BIT["repeated_lines"] | BIT["short_words"] | BIT["long_words"],
}

_BLANKS = r"[ \\t-\\r]+"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]


def _measured(docs: DataFrame, text: str) -> DataFrame:
    """Adds the measurements; each step is one projection over the arrays of the last."""
    d = docs.withColumn("_t", F.expr(f"coalesce(`{text}`, '')"))
    d = d.withColumns({
        "_w": F.expr(f"array_remove(split(_t, '{_BLANKS}'), '')"),
        "_l": F.expr(r"filter(split(_t, '\\n'), l -> l rlike '[^ \\t-\\r]')"),
        "n_symbols": F.expr(r"length(regexp_replace(_t, '[^#*$%&|<>]+', '')) + 0L"),
        "word_chars": F.expr(f"length(regexp_replace(_t, '{_BLANKS}', '')) + 0L"),
    })
    d = d.withColumns({
        "n_words": F.expr("size(_w) + 0L"),
        "n_lines": F.expr("size(_l) + 0L"),
        "n_dup_lines": F.expr("size(_l) - size(array_distinct(_l)) + 0L"),
        "_h": F.expr("transform(slice(_w, 1, greatest(size(_w) - 2, 0)), "
                     "(x, i) -> xxhash64(x, get(_w, i + 1), get(_w, i + 2)))"),
    })
    # only texts with a repeated window are sorted
    d = d.withColumn("_s", F.expr(
        "if(size(array_distinct(_h)) = size(_h), cast(array() as array<struct<h:bigint,i:int>>), "
        "sort_array(transform(_h, (x, i) -> named_struct('h', x, 'i', i))))"))
    d = d.withColumn("_p", F.expr(
        "sort_array(filter(transform(_s, (e, k) -> if(e.h <=> get(_s, k - 1).h or e.h <=> get(_s, k + 1).h, e.i, null)), "
        "i -> i is not null))"))
    d = d.withColumn("n_repeat_words", F.expr(
        f"aggregate(transform(_p, (p, k) -> least({WINDOW}, coalesce(get(_p, k + 1) - p, {WINDOW}))), 0L, (a, b) -> a + b)"))
    return d.drop("_t", "_w", "_l", "_h", "_s", "_p")


def with_ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the measurements and ``failed_bits``."""
    docs = docs.drop(*[c for c in [*MEASURES, "failed_bits"] if c != text])
    bits = " | ".join(f"if({sql}, {BIT[name]}L, 0L)" for name, sql in RULES.items())
    # A filter on the ledger must not be pushed below the measurements: their expressions would be
    # copied into it many times over. It stops at a projection that is not deterministic.
    return _measured(docs, text).withColumn("failed_bits", F.expr(f"if(monotonically_increasing_id() < 0, null, {bits})"))


def ledger(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One narrow row per document: its id, measurements and failure bits."""
    return with_ledger(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))).drop("text")


def apply_policy(led: DataFrame, version: str = "v1") -> DataFrame:
    """Adds ``base_failed`` and ``kept`` under the named policy; base failures never pass."""
    mask = POLICIES[version] | BASE_MASK
    return led.withColumns({
        "base_failed": F.expr(f"(failed_bits & {BASE_MASK}L) <> 0"),
        "kept": F.expr(f"(failed_bits & {mask}L) = 0"),
    })


def kept_documents(docs: DataFrame, version: str = "v1", text: str = "text") -> DataFrame:
    """The documents that a policy keeps, with their own columns."""
    whole = docs.select(F.struct(*docs.columns).alias("_doc"), F.col(text).alias("text"))
    return apply_policy(with_ledger(whole), version).where("kept").select("_doc.*")


def ablations(led: DataFrame, policies: dict = None) -> DataFrame:
    """Per policy and rule: documents rejected, failing the rule, and rejected by it alone.

    Ledger rows are first counted per distinct bit pattern (at most 2^rules groups, combined
    map-side); all policies are then computed from these few counts.
    """
    policies = policies or POLICIES
    patterns = led.groupBy("failed_bits").agg(F.count(F.lit(1)).alias("n"))
    cases = ", ".join(
        f"named_struct('policy', '{p}', 'rule', '{r}', 'mask', {m}L, 'bit', {BIT[r]}L)"
        for p, m in policies.items() for r in RULES if m & BIT[r])
    long = patterns.select("failed_bits", "n", F.expr(f"inline(array({cases}))"))
    hit = "(failed_bits & mask)"
    return long.groupBy("policy", "rule").agg(
        F.expr(f"sum(if({hit} <> 0, n, 0L))").alias("n_rejected"),
        F.expr("sum(if((failed_bits & bit) <> 0, n, 0L))").alias("n_failed_rule"),
        F.expr(f"sum(if({hit} = bit, n, 0L))").alias("n_only_this_rule"))
