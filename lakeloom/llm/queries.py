"""The queries of this subpackage, by name. SQL can't express those without an entry in SQL; they are tested against brute force."""

from __future__ import annotations

from lakeloom.llm import audio_features, bm25_decontamination, bpe_automaton, chat_formatting, embedding_whitening, factorisation_machine, language_profiles, license_scan, mincut_extraction, pii_surrogates, pipeline, simhash, token_alignment, token_shards

QUERIES = {
    "op1_audio_features": audio_features.op1_audio_features,
    "op2_pii_surrogates": pii_surrogates.op2_pii_surrogates,
    "op3_mincut_extraction": mincut_extraction.op3_mincut_extraction,
    "op4_bpe_automaton": bpe_automaton.op4_bpe_automaton,
    "op5_token_shards": token_shards.op5_token_shards,
    "op6_factorisation_machine": factorisation_machine.op6_factorisation_machine,
    "op7_simhash_bktree": simhash.op7_simhash_bktree,
    "op8_bm25_decontamination": bm25_decontamination.op8_bm25_decontamination,
    "op9_language_profiles": language_profiles.op9_language_profiles,
    "op10_license_scan": license_scan.op10_license_scan,
    "op11_chat_formatting": chat_formatting.op11_chat_formatting,
    "op12_embedding_whitening": embedding_whitening.op12_embedding_whitening,
    "op13_token_alignment": token_alignment.op13_token_alignment,
    "pipeline": pipeline.run,
}
SQL: dict[str, str] = {"op10_license_scan": license_scan.oracle()}
