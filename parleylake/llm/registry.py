"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from parleylake.llm import chat, decontam, embed_dedup, licenses, merkle, nbsvm, negatives, packing, reshard, secrets, simhash, urls, warc

QUERIES = {
    "op1_secret_scan": secrets.op1_secret_scan,
    "op2_preference_format": chat.op2_preference_format,
    "op3_reshard": reshard.op3_reshard,
    "op4_simhash_near_dedup": simhash.op4_simhash_near_dedup,
    "op5_best_fit_packing": packing.op5_best_fit_packing,
    "op6_warc": warc.op6_warc,
    "op7_embedding_near_dedup": embed_dedup.op7_embedding_near_dedup,
    "op8_license_scan": licenses.op8_license_scan,
    "op9_quality_classifier": nbsvm.op9_quality_classifier,
    "op10_decontamination": decontam.op10_decontamination,
    "op11_merkle_manifest": merkle.op11_merkle_manifest,
    "op12_url_filter": urls.op12_url_filter,
    "op13_hard_negatives": negatives.op13_hard_negatives,
}
#: Of the others, results are held against brute-force versions in tests/llm.
ORACLES = {"op2_preference_format": chat.ORACLE, "op6_warc": warc.ORACLE, "op7_embedding_near_dedup": embed_dedup.ORACLE, "op10_decontamination": decontam.ORACLE, "op11_merkle_manifest": merkle.ORACLE, "op12_url_filter": urls.ORACLE, "op13_hard_negatives": negatives.ORACLE}
