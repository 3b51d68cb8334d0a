"""Names, lists and patterns that results depend on. Fixed values, stated as text in their natural order."""

from __future__ import annotations

# Severities and their weights.
SEVERITIES = ("critical", "high", "medium", "low")
SEVERITY_WEIGHTS = {"critical": 4, "high": 3, "medium": 2, "low": 1}
RISK_WEIGHTS = {"critical": 10, "high": 5, "medium": 2, "low": 1}
SEVERITY_SPELLINGS = {"crit": "critical", "hi": "high", "med": "medium", "lo": "low", "important": "high", "minor": "low"}

# The standard procedure, and the phrases by which a rule names one of its steps.
STANDARD_STEPS = (
    "Application Received", "Document Verification", "Income Verification", "Credit Check",
    "Risk Assessment", "Manager Approval", "Final Approval",
)
STEP_PHRASES = (
    ("income verification", "Income Verification"),
    ("document verification", "Document Verification"),
    ("verify documents", "Document Verification"),
    ("credit check", "Credit Check"),
    ("risk assessment", "Risk Assessment"),
    ("manager approval", "Manager Approval"),
    ("final approval", "Final Approval"),
    ("application received", "Application Received"),
)

# Rule types.
RULE_TYPES = (
    "sequence", "approval", "timing", "eligibility", "credit_risk", "kyc", "aml", "documentation", "collateral",
    "disbursement", "post_disbursement_qc", "collection", "restructuring", "regulatory", "data_quality", "operational",
)

# Deviation types.
DEVIATION_TYPES = (
    "missing_step", "wrong_sequence", "unexpected_step", "duplicate_step", "skipped_mandatory_subprocess",
    "missing_approval", "insufficient_approval_hierarchy", "unauthorized_approver", "self_approval_violation",
    "escalation_missing", "timing_violation", "tat_breach", "cutoff_breach", "post_disbursement_qc_delay",
    "ineligible_age", "ineligible_tenor", "emi_to_income_breach", "low_score_approved_without_exception",
    "kyc_incomplete_progression", "sanctions_hit_not_rejected", "pep_no_edd_or_extra_approval",
    "missing_mandatory_document", "expired_document_used", "legal_clearance_missing", "collateral_docs_incomplete",
    "ltv_breach", "valuation_missing_or_stale", "security_not_created", "pre_disbursement_condition_unmet",
    "mandate_not_set_before_disbursement", "incorrect_disbursement_amount", "post_disbursement_qc_missing",
    "collection_escalation_delay", "unauthorized_restructure", "unauthorized_writeoff", "classification_mismatch",
    "provisioning_shortfall", "regulatory_report_missing_or_late", "missing_core_field", "invalid_format",
    "inconsistent_value_across_steps", "duplicate_active_case", "audit_trail_missing",
)

# Categories of deviation types, the first whose word is in the type's name.
CATEGORIES = (
    ("approval", ("approval", "unauthorized_approver", "self_approval", "escalation")),
    ("timing", ("timing_violation", "tat_breach", "cutoff_breach", "delay")),
    ("sequence", ("missing_step", "wrong_sequence", "unexpected_step", "duplicate_step")),
    ("documentation", ("document", "missing_mandatory_document", "expired_document")),
    ("kyc_aml", ("kyc", "aml", "sanctions", "pep", "cdd")),
    ("credit", ("credit", "score", "ltv_breach", "emi_to_income")),
    ("disbursement", ("disbursement", "mandate", "qc")),
    ("collection", ("collection", "restructure", "writeoff")),
    ("regulatory", ("regulatory", "classification", "provisioning")),
    ("data_quality", ("missing_core_field", "invalid_format", "inconsistent_value")),
)

# Lower bounds of the bands of the severity score and of the critical-mass score.
SEVERITY_BANDS = (
    (75, "Very High Risk - Immediate attention required"),
    (60, "High Risk - Urgent remediation needed"),
    (45, "Moderate Risk - Action plan required"),
    (30, "Low Risk - Monitoring recommended"),
    (None, "Minimal Risk - Routine oversight"),
)
CRITICAL_MASS_BANDS = (
    (75, "Critical - Systemic compliance failure"),
    (50, "Severe - Immediate executive attention required"),
    (30, "Elevated - Management intervention needed"),
    (15, "Moderate - Enhanced monitoring required"),
    (None, "Normal - Routine oversight sufficient"),
)
QUALITY_GRADES = ((95, "A"), (85, "B"), (70, "C"), (60, "D"), (None, "F"))

# Patterns by which a sentence is a rule, tried in this order, and the severity of each kind.
RULE_PATTERNS = (
    ("sequence", "high", (
        r"(first|then|next|after|before|finally)", r"step\s+\d+", r"must\s+be\s+completed\s+before", r"proceed\s+to", r"following\s+sequence",
    )),
    ("approval", "critical", (
        r"(must|shall|should)\s+be\s+approved\s+by", r"requires?\s+approval\s+(from|of)", r"authorized\s+by", r"manager\s+approval",
        r"senior\s+(officer|analyst|manager)",
    )),
    ("timing", "medium", (
        r"within\s+\d+\s+(days?|hours?|weeks?|months?)", r"before\s+\d+\s+(days?|hours?)", r"not\s+later\s+than", r"immediately", r"no\s+more\s+than",
    )),
    ("validation", "high", (r"must\s+verify", r"check\s+(for|that)", r"validate", r"ensure\s+that", r"confirm", r"review")),
)

# Fields that a log must have, and headers that stand for them when logs are read without a mapping.
REQUIRED_FIELDS = ("case_id", "officer_id", "step_name", "action", "timestamp")
LOG_ALIASES = (
    ("case_id", ("case_id", "caseId", "CaseID", "Case ID", "case", "Loan_ID", "LoanID", "loan_id")),
    ("officer_id", ("officer_id", "officerId", "OfficerID", "Officer ID", "officer", "User", "user", "user_id")),
    ("step_name", ("step_name", "stepName", "StepName", "Step Name", "step", "Step", "Activity", "activity", "action")),
    ("action", ("action", "Action", "Decision", "decision")),
    ("timestamp", ("timestamp", "Timestamp", "date", "Date", "time", "Time")),
    ("duration_seconds", ("duration_seconds", "duration", "Duration")),
    ("status", ("status", "Status", "Decision", "decision")),
    ("notes", ("notes", "Notes", "comments", "Comments", "remarks", "Remarks")),
)

# Fields that a log can have besides.
OPTIONAL_FIELDS = (
    "duration_seconds", "status", "notes", "comments", "step_id", "stage_name", "workflow_version", "action_type", "sub_status",
    "application_id", "loan_id", "customer_id", "customer_name", "customer_segment", "customer_type", "customer_risk_rating",
    "group_id", "related_party_flag", "staff_flag", "portfolio_id",
    "product_type", "sub_product_type", "scheme_code", "secured_unsecured_flag", "channel", "branch_code", "branch_name", "region", "geo_code",
    "loan_amount_requested", "loan_amount_sanctioned", "loan_amount_disbursed", "interest_rate", "interest_type", "processing_fee", "other_charges",
    "tenor_months", "tenor_days", "repayment_frequency", "emi_amount", "ltv_ratio", "margin_pct", "total_group_exposure", "customer_total_exposure",
    "credit_score_bureau", "credit_score_internal", "scorecard_version", "score_band", "emi_to_income_ratio", "dti_ratio", "risk_grade", "risk_category",
    "collateral_type", "collateral_description", "collateral_value", "collateral_value_date", "valuation_status", "valuation_firm_id",
    "security_created_flag", "security_perfected_flag",
    "kyc_status", "kyc_completed_flag", "kyc_date", "kyc_mode", "sanctions_hit_flag", "watchlist_hit_flag", "pep_flag", "aml_risk_rating",
    "officer_name", "officer_role", "approval_role", "approval_level", "timestamp_start", "timestamp_end", "step_time", "business_date",
    "queue_name", "queue_priority", "sla_target_timestamp", "sla_breach_flag",
    "approver_id", "approver_role", "approval_decision", "approval_timestamp", "exception_flag", "exception_reason", "exception_approver_id",
    "override_flag", "override_reason", "override_approver_id",
    "disbursement_date", "disbursement_amount", "disbursement_mode", "mandate_status", "first_emi_date", "statement_generated_flag",
    "post_disbursement_qc_flag", "post_disbursement_qc_date", "qc_findings",
    "overdue_days", "bucket", "collection_status", "collection_agent_id", "restructure_flag", "restructure_date", "restructure_type",
    "writeoff_flag", "writeoff_amount", "writeoff_date",
    "created_by", "created_at", "updated_by", "updated_at", "source_system", "source_file_name", "import_batch_id",
    "audit_trail_id", "log_level", "error_code", "error_message",
)

# Headers, or parts of headers, that stand for a field; the first field in this order wins.
HEADER_PATTERNS = (
    ("case_id", ("case_id", "caseid", "case id", "loan_id", "loanid", "loan id", "application_id", "case", "loan", "application")),
    ("officer_id", ("officer_id", "officerid", "officer id", "user", "user_id", "userid", "employee", "employee_id", "staff_id")),
    ("step_name", ("step_name", "stepname", "step name", "step", "activity", "task", "stage", "stage_name")),
    ("action", ("action", "decision", "outcome", "action_type")),
    ("timestamp", ("timestamp", "date", "time", "datetime", "created_at", "date_time", "transaction_time")),
    ("duration_seconds", ("duration", "duration_seconds", "time_taken", "elapsed", "processing_time")),
    ("status", ("status", "state", "sub_status")),
    ("notes", ("notes", "comments", "comment", "remarks", "note", "explanation", "reason", "justification")),
    ("customer_id", ("customer_id", "customerid", "client_id", "cust_id", "borrower_id")),
    ("customer_name", ("customer_name", "customername", "client_name", "borrower_name", "applicant_name")),
    ("loan_amount_requested", ("loan_amount", "amount_requested", "requested_amount", "loan_amt", "principal")),
    ("loan_amount_sanctioned", ("amount_sanctioned", "sanctioned_amount", "approved_amount", "sanction_amt")),
    ("loan_amount_disbursed", ("amount_disbursed", "disbursed_amount", "disbursal_amount", "disbursement_amt")),
    ("product_type", ("product_type", "product", "loan_type", "product_name", "scheme")),
    ("branch_code", ("branch_code", "branch", "branch_id", "location_code")),
    ("channel", ("channel", "source_channel", "origination_channel")),
    ("credit_score_bureau", ("credit_score", "bureau_score", "cibil_score", "score")),
    ("emi_to_income_ratio", ("emi_ratio", "emi_to_income", "debt_to_income", "dti", "emi_income_ratio")),
    ("ltv_ratio", ("ltv", "ltv_ratio", "loan_to_value")),
    ("risk_grade", ("risk_grade", "risk_rating", "risk_category", "rating")),
    ("kyc_status", ("kyc_status", "kyc", "kyc_verified", "kyc_complete")),
    ("sanctions_hit_flag", ("sanctions_hit", "sanctions", "watchlist_hit", "screening_result")),
    ("pep_flag", ("pep", "pep_flag", "politically_exposed")),
    ("collateral_type", ("collateral_type", "collateral", "security_type", "asset_type")),
    ("collateral_value", ("collateral_value", "security_value", "asset_value", "property_value")),
    ("approver_id", ("approver_id", "approver", "approved_by", "sanctioned_by")),
    ("approval_decision", ("approval_decision", "approval", "decision")),
    ("exception_flag", ("exception", "exception_flag", "deviation", "override")),
    ("disbursement_date", ("disbursement_date", "disbursal_date", "payout_date", "release_date")),
    ("disbursement_amount", ("disbursement_amount", "disbursal_amt", "payout_amount")),
    ("overdue_days", ("overdue_days", "dpd", "days_past_due", "delinquent_days")),
    ("bucket", ("bucket", "dpd_bucket", "collection_bucket", "aging_bucket")),
)

# Days of the week, Monday first, and periods of the day with their hours.
WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
PERIODS = (("night", 0, 6), ("morning", 6, 12), ("afternoon", 12, 18), ("evening", 18, 24))

# English words without weight in texts, Spark ML's own list.
STOP_WORDS = tuple(
    """
    i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs
    themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or
    because as until while of at by for with about against between into through during before after above below to from up down in out on off over under
    again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t
    can will just don should now i'll you'll he'll she'll we'll they'll i'd you'd he'd she'd we'd they'd i'm you're he's she's it's we're they're i've
    we've you've they've isn't aren't wasn't weren't haven't hasn't hadn't don't doesn't didn't won't wouldn't shan't shouldn't mustn't can't couldn't
    cannot could here's how's let's ought that's there's what's when's where's who's why's would
    """.split()
)
