"""The report's texts as the SQL oracle states them: fixed values, written out apart
from the engine's own so that a slip in either shows."""

#: (signal, claim type, statute)
SIGNAL_TEXT = [
    ('excluded_provider',
     'Presenting false claims — excluded provider cannot legally bill federal healthcare programs',
     '31 U.S.C. § 3729(a)(1)(A)'),
    ('billing_outlier',
     'Potential overbilling — provider billing far exceeds peer group norms suggesting inflated or fabricated claims',
     '31 U.S.C. § 3729(a)(1)(A)'),
    ('rapid_escalation',
     'Potential bust-out scheme — new entity with explosive billing growth consistent with fraud-and-flee pattern',
     '31 U.S.C. § 3729(a)(1)(A)'),
    ('workforce_impossibility',
     'False records — billing volume physically impossible for reported workforce, implying fabricated claims',
     '31 U.S.C. § 3729(a)(1)(B)'),
    ('shared_official',
     'Conspiracy — coordinated billing through multiple entities controlled by same individual suggests shell company network',
     '31 U.S.C. § 3729(a)(1)(C)'),
    ('geographic_implausibility',
     'Reverse false claims — repeated billing on same patients with implausible geographic patterns',
     '31 U.S.C. § 3729(a)(1)(G)'),
]

#: (signal, step number, step)
STEP_TEXT = [
    ('excluded_provider', 1, 'Verify exclusion status on OIG LEIE website and confirm NPI match'),
    ('excluded_provider', 2, 'Request payment records from state Medicaid agency for the post-exclusion period'),
    ('excluded_provider', 3, 'Initiate recovery action for all payments made after exclusion date'),
    ('excluded_provider', 4, 'Refer to OIG for potential criminal prosecution under 42 U.S.C. § 1320a-7b'),
    ('billing_outlier', 1, 'Request detailed claims data and supporting documentation from provider'),
    ('billing_outlier', 2, 'Compare service patterns against peer group norms for the same taxonomy and state'),
    ('billing_outlier', 3, 'Conduct desk audit of highest-volume service codes'),
    ('billing_outlier', 4, 'Consider on-site audit if billing exceeds 5x peer median'),
    ('rapid_escalation', 1, 'Review provider enrollment application and supporting documentation'),
    ('rapid_escalation', 2, 'Analyze service code distribution for patterns consistent with upcoding'),
    ('rapid_escalation', 3, 'Interview beneficiaries to verify services were rendered'),
    ('rapid_escalation', 4, 'Place provider on prepayment review if growth exceeds 500%'),
    ('workforce_impossibility', 1, 'Request organizational staffing records and provider schedules'),
    ('workforce_impossibility', 2, 'Cross-reference NPI sub-parts and rendering providers'),
    ('workforce_impossibility', 3, 'Analyze time-of-day claim patterns for statistical impossibilities'),
    ('workforce_impossibility', 4, 'Conduct unannounced site visit to verify staffing levels'),
    ('shared_official', 1, 'Map all NPIs controlled by the authorized official and their corporate relationships'),
    ('shared_official', 2, 'Analyze billing patterns across all controlled entities for coordination'),
    ('shared_official', 3, 'Review state corporate filings for common ownership structures'),
    ('shared_official', 4, 'Investigate for potential kickback or self-referral arrangements'),
    ('geographic_implausibility', 1, 'Map beneficiary addresses against provider service area'),
    ('geographic_implausibility', 2, 'Review travel logs and service delivery documentation'),
    ('geographic_implausibility', 3, 'Interview a sample of beneficiaries to verify services received'),
    ('geographic_implausibility', 4, 'Analyze GPS data from electronic visit verification systems if available'),
]
