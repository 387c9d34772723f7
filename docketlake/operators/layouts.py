"""Record layouts of the model passes. Field lists and vocabularies are fixed values."""

STRING, BOOL, LONG, STRINGS = "string", "boolean", "bigint", "array<string>"

TIER_B = {
    "judgment_type": STRING, "sentence_type": STRING, "appeal_outcome": STRING,
    "offense_category": STRING, "severity_level": STRING, "special_law": STRING, "motive_category": STRING,
    "murder_category": STRING, "premeditation_indicators": STRINGS, "provocation_claimed": BOOL,
    "abetment_type": STRING, "cnsa_quantity_classification": STRING, "recovery_circumstances": STRING,
    "weapon_type": STRING, "forensic_evidence_types": STRINGS, "documentary_evidence_types": STRINGS,
    "evidence_classification": STRING, "expert_witness_present": BOOL, "witness_impeached": BOOL,
    "accomplice_witness": BOOL, "accomplices_count": LONG, "investigation_quality": STRING,
    "aggravating_factors": STRINGS, "mitigating_factors": STRINGS, "benefit_of_doubt_applied": BOOL,
    "accused_age_at_offense": LONG, "criminal_history_count": LONG,
    "complainant_relation_to_victim": STRING, "complainant_motive_bias": STRINGS,
    "witness_interest_in_case": STRING, "witness_relationship_to_parties": STRING,
    "witness_impeachment_ground": STRINGS, "accomplice_testimony_corroboration": BOOL,
    "conflicting_expert_opinions": BOOL,
    "motive_strength": STRING, "motive_proven": BOOL, "alibi_evidence_strength": STRING,
    "presence_at_crime_scene": STRING, "last_seen_together_evidence": BOOL,
    "consciousness_of_guilt_evidence": STRINGS, "recovery_from_possession": BOOL,
    "pm_report_quality": STRING, "injury_count": LONG, "injury_severity": STRING,
    "weapon_forensic_tested": BOOL, "hearsay_exception_applied": STRING,
    "evidence_illegally_obtained": BOOL, "similar_fact_evidence": BOOL, "expert_opinion_overruled": BOOL,
    "accused_prior_criminal_convictions": BOOL,
    "fir_discrepancies_with_testimony": STRINGS, "investigation_defect_description": STRINGS,
    "section_164_voluntariness_challenged": BOOL, "section_164_officer_present": STRING,
    "police_brutality_fir": BOOL, "fir_based_on_suspicion_only": BOOL, "defense_adequate": STRING,
    "charges_framed_properly": BOOL, "cross_examination_quality_assessment": STRING,
    "eyewitness_visibility_conditions": STRING, "eyewitness_familiarity_with_accused": STRING,
    "eyewitness_identification_procedure_defects": STRINGS,
    "prosecution_strength_rating": STRING, "conviction_certainty": STRING, "conviction_strength": STRING,
    "brutality_level": STRING, "victim_vulnerability": STRING, "provocation_evidence_weight": STRING,
    "mental_illness": BOOL, "intoxication_at_time": BOOL, "cooperation_with_prosecution": BOOL,
    "remorse_shown": BOOL, "first_offense": BOOL,
    "defense_strategy_primary": STRING, "prosecution_strategy_primary": STRING,
    "self_defense_claimed": BOOL, "insanity_plea": BOOL, "confession_voluntary": BOOL,
    "confession_corroborated": BOOL, "confessional_statement": BOOL, "honor_crime_defense": BOOL,
    "honor_crime_motive": STRING, "sexual_offense_type": STRING, "victim_delay_reporting": LONG,
    "sectarian_violence_case": BOOL, "rape_murder_combined": BOOL, "grounds_for_appeal_list": STRINGS,
    "defect_fatal_to_conviction": BOOL, "defects_cumulatively_fatal": BOOL,
    "eyewitness_sole_evidence": BOOL, "reasonable_doubt_not_applied_ground": BOOL,
    "judgment_reasoning_quality": STRING,
}

TIER_C = [
    "cause_of_death_description", "injury_pattern_analysis", "dying_declaration_content",
    "accused_342_statement", "provocation_evidence", "motive_evidence", "recovery_explanation",
    "knowledge_only_culprit_would_have", "sentence_justification_leniency", "fir_discrepancy_details",
    "investigation_defect_details", "expert_findings_key", "accomplices_details",
    "witness_admission_during_cross", "points_for_determination", "ratio_decidendi", "operative_order_text",
]

POINT_TYPES = [
    "facts", "issue", "petitioner_argument", "respondent_argument", "evidence", "court_reasoning",
    "ratio_decidendi", "obiter_dicta", "final_order", "dissent",
]

VOCABULARIES = {
    "judgment_type": ["conviction", "acquittal", "partial_conviction", "dismissal", "remand", "sentence_modified",
                      "monitoring_order"],
    "sentence_type": ["death", "life", "rigorous", "simple", "fine_only", "acquitted"],
    "appeal_outcome": ["allowed", "dismissed", "partially_allowed", "remanded"],
    "offense_category": ["person", "property", "state", "religion", "public_health"],
    "severity_level": ["capital", "life", "long_term_7plus", "medium_3to7", "short_under3"],
    "special_law": ["anti_terrorism", "cnsa", "hudood", "juvenile", "contempt", "nab", "cyber", "none"],
    "weapon_type": ["firearm", "knife", "blunt", "poison", "explosive", "none"],
}
