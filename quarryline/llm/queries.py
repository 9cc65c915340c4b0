"""The queries of the operators and their SQL."""

from quarryline.llm import bpe, decontaminate, licences, mixing, near, periods, quality, rules, secrets, tokens, toxicity, urls, whitening

QUERIES = {
    "op1_token_codes": tokens.op1_token_codes,
    "op2_licence_scan": licences.op2_licence_scan,
    "op3_decontamination": decontaminate.op3_decontamination,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_secret_scan": secrets.op5_secret_scan,
    "op6_mixing": mixing.op6_mixing,
    "op7_quality_classifier": quality.op7_quality_classifier,
    "op8_url_filter": urls.op8_url_filter,
    "op9_ngram_jaccard": near.op9_ngram_jaccard,
    "op10_quality_rules": rules.op10_quality_rules,
    "op11_byte_bpe": bpe.op11_byte_bpe,
    "op12_periodic_runs": periods.op12_periodic_runs,
    "op13_whitening": whitening.op13_whitening,
}
ORACLE_SQL = {
    "op3_decontamination": decontaminate.OP3_SQL,
    "op6_mixing": mixing.OP6_SQL,
    "op8_url_filter": urls.OP8_SQL,
    "op9_ngram_jaccard": near.OP9_SQL,
}
