"""The registered queries of this subpackage and their SQL twins."""

from . import (
    contamination,
    hard_negatives,
    hidden_markov,
    jaccard,
    language_id,
    licenses,
    line_rules,
    mixing,
    ordinal,
    prefix_trie,
    substrings,
    token_counts,
    toxicity,
)

QUERIES = {
    "op1_hidden_markov": hidden_markov.op1_hidden_markov,
    "op2_substring_dedup": substrings.op2_substring_dedup,
    "op3_pareto_mix": mixing.op3_pareto_mix,
    "op4_line_rules": line_rules.op4_line_rules,
    "op5_edit_counts": token_counts.op5_edit_counts,
    "op6_ordinal_quality": ordinal.op6_ordinal_quality,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_license_scan": licenses.op8_license_scan,
    "op9_jaccard_join": jaccard.op9_jaccard_join,
    "op10_containment": contamination.op10_containment,
    "op11_language_id": language_id.op11_language_id,
    "op12_prefix_trie": prefix_trie.op12_prefix_trie,
    "op13_hard_negatives": hard_negatives.op13_hard_negatives,
}

#: Where SQL can state the result; the others are tested against brute force.
ORACLE = {
    "op3_pareto_mix": mixing.OP3_SQL,
    "op4_line_rules": line_rules.op4_sql(),
    "op8_license_scan": licenses.op8_sql(),
    "op10_containment": contamination.OP10_SQL,
    "op12_prefix_trie": prefix_trie.OP12_SQL,
    "op13_hard_negatives": hard_negatives.OP13_SQL,
}
