"""Fixed dimensions of the contract engine: labels, rules, thresholds and vocabularies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Label, category, severity when present, re-assessed by a model, severity when missing, standard protection.
LABELS: list[tuple[str, str, str, bool, str | None, bool]] = [
    ("Document Name", "general_information", "INFO", False, None, False),
    ("Parties", "general_information", "INFO", False, None, False),
    ("Agreement Date", "general_information", "LOW", False, None, False),
    ("Effective Date", "general_information", "MEDIUM", False, None, False),
    ("Expiration Date", "general_information", "MEDIUM", False, None, False),
    ("Renewal Term", "general_information", "MEDIUM", False, None, False),
    ("Notice Period To Terminate Renewal", "general_information", "HIGH", False, "HIGH", True),
    ("Governing Law", "general_information", "MEDIUM", False, "MEDIUM", True),
    ("License Grant", "general_information", "HIGH", True, None, False),
    ("Irrevocable Or Perpetual License", "general_information", "LOW", False, None, False),
    ("Anti-Assignment", "restrictive_covenants", "MEDIUM", False, None, True),
    ("Non-Compete", "restrictive_covenants", "HIGH", True, None, False),
    ("Non-Disparagement", "restrictive_covenants", "LOW", False, None, False),
    ("No-Solicit Of Employees", "restrictive_covenants", "MEDIUM", False, None, False),
    ("No-Solicit Of Customers", "restrictive_covenants", "MEDIUM", False, None, False),
    ("Exclusivity", "restrictive_covenants", "CRITICAL", True, None, False),
    ("Change Of Control", "restrictive_covenants", "HIGH", False, None, True),
    ("Covenant Not To Sue", "restrictive_covenants", "HIGH", True, None, False),
    ("Competitive Restriction Exception", "restrictive_covenants", "LOW", False, None, False),
    ("Non-Transferable License", "restrictive_covenants", "MEDIUM", False, None, False),
    ("Volume Restriction", "restrictive_covenants", "MEDIUM", False, None, False),
    ("Cap On Liability", "revenue_risks", "HIGH", True, "CRITICAL", True),
    ("Uncapped Liability", "revenue_risks", "CRITICAL", True, None, False),
    ("Liquidated Damages", "revenue_risks", "HIGH", True, None, False),
    ("Revenue/Profit Sharing", "revenue_risks", "HIGH", True, None, False),
    ("Minimum Commitment", "revenue_risks", "HIGH", False, None, False),
    ("Audit Rights", "revenue_risks", "MEDIUM", False, None, False),
    ("Insurance", "revenue_risks", "MEDIUM", False, "LOW", True),
    ("Warranty Duration", "revenue_risks", "MEDIUM", False, "MEDIUM", True),
    ("Post-Termination Services", "revenue_risks", "MEDIUM", False, "MEDIUM", True),
    ("Termination For Convenience", "revenue_risks", "HIGH", False, "MEDIUM", True),
    ("IP Ownership Assignment", "intellectual_property", "CRITICAL", True, None, False),
    ("Joint IP Ownership", "intellectual_property", "HIGH", True, None, False),
    ("Source Code Escrow", "intellectual_property", "LOW", False, "HIGH", True),
    ("Affiliate License-Licensor", "intellectual_property", "LOW", False, None, False),
    ("Affiliate License-Licensee", "intellectual_property", "LOW", False, None, False),
    ("Unlimited/All-You-Can-Eat-License", "intellectual_property", "LOW", False, None, False),
    ("Third Party Beneficiary", "special_provisions", "MEDIUM", False, None, False),
    ("Most Favored Nation", "special_provisions", "HIGH", False, None, False),
    ("Rofr/Rofo/Rofn", "special_provisions", "MEDIUM", True, None, False),
]

# Typical phrases of each label.
LABEL_PATTERNS: dict[str, list[str]] = {
    "Document Name": ["This Agreement", "This License Agreement", "This Master Services Agreement", "This Software License Agreement"],
    "Parties": ["between Company A and Company B", "by and between", "the parties hereto", "Licensor and Licensee"],
    "Agreement Date": ["dated as of", "entered into as of", "executed on", "effective as of the date first written above"],
    "Effective Date": ["effective date", "shall become effective", "commencing on", "takes effect on"],
    "Expiration Date": ["shall expire on", "termination date", "until", "for a period of", "initial term"],
    "Renewal Term": ["shall automatically renew", "successive renewal terms", "renewal period", "extend for additional"],
    "Notice Period To Terminate Renewal": ["days prior written notice", "notice of non-renewal", "terminate upon notice", "written notice of termination"],
    "Governing Law": ["governed by the laws of", "construed in accordance with", "subject to the laws of", "jurisdiction of"],
    "License Grant": ["hereby grants", "license to use", "right and license", "non-exclusive license", "exclusive license"],
    "Irrevocable Or Perpetual License": ["irrevocable license", "perpetual license", "in perpetuity", "forever", "irrevocable right"],
    "Anti-Assignment": ["shall not assign", "may not assign without consent", "assignment requires approval", "non-assignable"],
    "Non-Compete": ["shall not compete", "non-competition", "competitive activities", "refrain from competing"],
    "Non-Disparagement": ["shall not disparage", "non-disparagement", "negative statements", "detrimental comments"],
    "No-Solicit Of Employees": ["shall not solicit employees", "non-solicitation of employees", "hiring restriction", "recruit employees"],
    "No-Solicit Of Customers": ["shall not solicit customers", "non-solicitation of customers", "customer restrictions", "solicit business from"],
    "Exclusivity": ["exclusive", "sole and exclusive", "exclusively", "exclusive right", "exclusive provider"],
    "Change Of Control": ["change of control", "change in ownership", "merger or acquisition", "sale of assets", "controlling interest"],
    "Covenant Not To Sue": ["covenant not to sue", "waiver of claims", "release of claims", "shall not bring any action"],
    "Competitive Restriction Exception": ["except for", "notwithstanding the foregoing", "shall not apply to", "exception to non-compete"],
    "Non-Transferable License": ["non-transferable", "may not transfer", "personal license", "cannot sublicense"],
    "Volume Restriction": ["volume limitations", "quantity restrictions", "usage limits", "maximum units"],
    "Cap On Liability": ["liability shall not exceed", "maximum liability", "cap on damages", "limitation of liability", "aggregate liability"],
    "Uncapped Liability": ["unlimited liability", "shall not be subject to any limitation", "notwithstanding any limitation", "uncapped"],
    "Liquidated Damages": ["liquidated damages", "stipulated damages", "agreed damages", "per day penalty"],
    "Revenue/Profit Sharing": ["revenue sharing", "profit sharing", "share of revenue", "percentage of profits", "royalty"],
    "Minimum Commitment": ["minimum commitment", "minimum purchase", "minimum order", "guaranteed minimum"],
    "Audit Rights": ["audit rights", "right to audit", "inspect books and records", "examination of records"],
    "Insurance": ["shall maintain insurance", "insurance coverage", "proof of insurance", "certificate of insurance"],
    "Warranty Duration": ["warranty period", "warranty duration", "warrants for a period of", "warranty expires"],
    "Post-Termination Services": ["post-termination", "following termination", "survive termination", "transition services", "wind-down"],
    "Termination For Convenience": ["terminate for convenience", "terminate without cause", "terminate at any time", "terminate for any reason"],
    "IP Ownership Assignment": ["assigns all right, title and interest", "transfer of ownership", "work for hire", "all IP shall belong to", "assigns intellectual property"],
    "Joint IP Ownership": ["jointly owned", "joint ownership", "co-owned", "shared ownership"],
    "Source Code Escrow": ["source code escrow", "escrow agent", "escrow arrangement", "deposit source code"],
    "Affiliate License-Licensor": ["licensor's affiliates", "affiliates of licensor", "licensor and its affiliates"],
    "Affiliate License-Licensee": ["licensee's affiliates", "affiliates of licensee", "licensee and its affiliates", "subsidiary license"],
    "Unlimited/All-You-Can-Eat-License": ["unlimited license", "unlimited users", "enterprise-wide", "site license", "unlimited usage"],
    "Third Party Beneficiary": ["third party beneficiary", "no third party rights", "intended beneficiary"],
    "Most Favored Nation": ["most favored nation", "most favored customer", "MFN", "best pricing"],
    "Rofr/Rofo/Rofn": ["right of first refusal", "right of first offer", "right of first negotiation", "ROFR", "ROFO"],
}

# Fixed values, in the order that decides which edge of a pair is kept: source, target, type, strength, both ways, to be validated.
DEPENDENCY_RULES: list[tuple[str, str, str, float, bool, bool]] = [
    ("Renewal Term", "Notice Period To Terminate Renewal", "REQUIRES", 0.95, False, False),
    ("Renewal Term", "Expiration Date", "REQUIRES", 0.9, False, False),
    ("Revenue/Profit Sharing", "Audit Rights", "REQUIRES", 0.9, False, False),
    ("Exclusivity", "Expiration Date", "REQUIRES", 0.85, False, False),
    ("Non-Compete", "Expiration Date", "REQUIRES", 0.85, False, False),
    ("Non-Compete", "Governing Law", "REQUIRES", 0.8, False, False),
    ("Liquidated Damages", "Cap On Liability", "REQUIRES", 0.75, False, True),
    ("Termination For Convenience", "Notice Period To Terminate Renewal", "REQUIRES", 0.7, False, False),
    ("IP Ownership Assignment", "Parties", "REQUIRES", 0.95, False, False),
    ("License Grant", "Parties", "REQUIRES", 0.95, False, False),
    ("Change Of Control", "Anti-Assignment", "REQUIRES", 0.7, False, True),
    ("Minimum Commitment", "Expiration Date", "REQUIRES", 0.8, False, False),
    ("Minimum Commitment", "Termination For Convenience", "REQUIRES", 0.65, False, True),
    ("Post-Termination Services", "Expiration Date", "REQUIRES", 0.85, False, False),
    ("Warranty Duration", "Effective Date", "REQUIRES", 0.8, False, False),
    ("No-Solicit Of Employees", "Expiration Date", "REQUIRES", 0.75, False, False),
    ("No-Solicit Of Customers", "Expiration Date", "REQUIRES", 0.75, False, False),
    ("Joint IP Ownership", "Parties", "REQUIRES", 0.9, False, False),
    ("Source Code Escrow", "License Grant", "REQUIRES", 0.85, False, False),
    ("Most Favored Nation", "Audit Rights", "REQUIRES", 0.7, False, True),
    ("Insurance", "Cap On Liability", "REQUIRES", 0.6, False, True),
    ("Rofr/Rofo/Rofn", "Notice Period To Terminate Renewal", "REQUIRES", 0.65, False, False),
    ("Cap On Liability", "Uncapped Liability", "CONFLICTS_WITH", 0.9, True, True),
    ("License Grant", "IP Ownership Assignment", "CONFLICTS_WITH", 0.7, True, True),
    ("Exclusivity", "Non-Transferable License", "CONFLICTS_WITH", 0.6, True, True),
    ("Volume Restriction", "Unlimited/All-You-Can-Eat-License", "CONFLICTS_WITH", 0.95, True, False),
    ("Termination For Convenience", "Irrevocable Or Perpetual License", "CONFLICTS_WITH", 0.75, True, True),
    ("Non-Compete", "Competitive Restriction Exception", "CONFLICTS_WITH", 0.6, True, True),
    ("Anti-Assignment", "Affiliate License-Licensee", "CONFLICTS_WITH", 0.5, True, True),
    ("Exclusivity", "Affiliate License-Licensor", "CONFLICTS_WITH", 0.55, True, True),
    ("Insurance", "Uncapped Liability", "MITIGATES", 0.8, False, False),
    ("Cap On Liability", "Liquidated Damages", "MITIGATES", 0.75, False, False),
    ("Irrevocable Or Perpetual License", "Termination For Convenience", "MITIGATES", 0.7, False, False),
    ("Source Code Escrow", "Termination For Convenience", "MITIGATES", 0.75, False, False),
    ("Post-Termination Services", "Termination For Convenience", "MITIGATES", 0.7, False, False),
    ("Competitive Restriction Exception", "Non-Compete", "MITIGATES", 0.65, False, False),
    ("Warranty Duration", "Uncapped Liability", "MITIGATES", 0.5, False, True),
    ("Audit Rights", "Revenue/Profit Sharing", "MITIGATES", 0.7, False, False),
    ("Insurance", "Liquidated Damages", "MITIGATES", 0.65, False, False),
    ("Anti-Assignment", "License Grant", "RESTRICTS", 0.8, False, False),
    ("Governing Law", "Non-Compete", "RESTRICTS", 0.7, False, False),
    ("Volume Restriction", "License Grant", "RESTRICTS", 0.85, False, False),
    ("Non-Transferable License", "License Grant", "RESTRICTS", 0.9, False, False),
    ("Non-Compete", "License Grant", "RESTRICTS", 0.6, False, True),
    ("Anti-Assignment", "Change Of Control", "RESTRICTS", 0.75, False, False),
    ("Governing Law", "Exclusivity", "RESTRICTS", 0.55, False, True),
    ("Cap On Liability", "Revenue/Profit Sharing", "RESTRICTS", 0.5, False, True),
    ("Covenant Not To Sue", "Uncapped Liability", "RESTRICTS", 0.7, False, False),
    ("Expiration Date", "Non-Compete", "RESTRICTS", 0.6, False, True),
    ("Liquidated Damages", "Cap On Liability", "MODIFIES", 0.8, False, True),
    ("Renewal Term", "Expiration Date", "MODIFIES", 0.9, False, False),
    ("Affiliate License-Licensee", "License Grant", "MODIFIES", 0.75, False, False),
    ("Affiliate License-Licensor", "License Grant", "MODIFIES", 0.7, False, False),
    ("Change Of Control", "Renewal Term", "MODIFIES", 0.65, False, True),
    ("Most Favored Nation", "Revenue/Profit Sharing", "MODIFIES", 0.7, False, False),
    ("Most Favored Nation", "Minimum Commitment", "MODIFIES", 0.65, False, False),
    ("Competitive Restriction Exception", "Exclusivity", "MODIFIES", 0.6, False, False),
    ("Post-Termination Services", "Expiration Date", "MODIFIES", 0.7, False, False),
    ("Third Party Beneficiary", "License Grant", "MODIFIES", 0.55, False, True),
    ("Rofr/Rofo/Rofn", "Anti-Assignment", "MODIFIES", 0.6, False, False),
    ("Change Of Control", "Termination For Convenience", "MODIFIES", 0.7, False, True),
    ("Non-Compete", "No-Solicit Of Employees", "DEPENDS_ON", 0.7, False, False),
    ("Non-Compete", "No-Solicit Of Customers", "DEPENDS_ON", 0.7, False, False),
    ("No-Solicit Of Employees", "No-Solicit Of Customers", "DEPENDS_ON", 0.6, True, False),
    ("License Grant", "Parties", "DEPENDS_ON", 0.95, False, False),
    ("Expiration Date", "Effective Date", "DEPENDS_ON", 0.9, False, False),
    ("Renewal Term", "Agreement Date", "DEPENDS_ON", 0.6, False, False),
    ("Cap On Liability", "License Grant", "DEPENDS_ON", 0.5, False, True),
    ("Warranty Duration", "Agreement Date", "DEPENDS_ON", 0.65, False, False),
    ("Exclusivity", "License Grant", "DEPENDS_ON", 0.85, False, False),
    ("IP Ownership Assignment", "License Grant", "DEPENDS_ON", 0.6, False, True),
    ("Non-Disparagement", "Governing Law", "DEPENDS_ON", 0.5, False, False),
    ("Minimum Commitment", "Revenue/Profit Sharing", "DEPENDS_ON", 0.6, False, True),
]

# Fixed values.
SEVERITY_WEIGHTS = {"CRITICAL": 25, "HIGH": 15, "MEDIUM": 8, "LOW": 3, "INFO": 0}
MISSING_FACTOR = 0.75
SCORE_CAP = 150
# fixed values: least scores of the levels
RISK_BANDS = [(75, "CRITICAL"), (50, "HIGH"), (25, "MEDIUM"), (0, "LOW")]
# fixed values: labels whose severity hangs on wording
LIABILITY_LABELS = ["Uncapped Liability", "Cap On Liability", "Liquidated Damages"]
# fixed values: words that bind both sides
MUTUAL_WORDING = [r"\beither\s+party\b", r"\bneither\s+party\b", r"\bboth\s+parties\b", r"\beach\s+party\b", r"\bno\s+party\b", r"\bthe\s+parties\b", r"\bmutual(?:ly)?\b"]
# fixed values: types of entities
NODE_TYPES = ["Party", "IPAsset", "Obligation", "Restriction", "LiabilityProvision", "Temporal", "Jurisdiction", "ContractClause", "Contract"]
# fixed values: types of relationships
EDGE_TYPES = ["LICENSES_TO", "OWNS", "ASSIGNS", "HAS_OBLIGATION", "SUBJECT_TO_RESTRICTION", "HAS_LIABILITY", "GOVERNED_BY", "CONTAINS_CLAUSE", "EFFECTIVE_ON", "TERMINATES_ON"]
# fixed values: similarity by type
AGGREGATION_THRESHOLDS = {"Party": 0.85, "Obligation": 0.78, "Restriction": 0.78, "IPAsset": 0.82, "Temporal": 0.90, "Jurisdiction": 0.90, "LiabilityProvision": 0.80, "ContractClause": 0.75}
DEFAULT_AGGREGATION_THRESHOLD = 0.80
RESOLUTION_THRESHOLD = 0.80
# fixed values: the calibration's parameters
PLATT_A, PLATT_B = -6.0540, 2.2416
# fixed values: confidences in words
CONFIDENCE_WORDS = {"LOW": 0.4, "MEDIUM": 0.7, "HIGH": 0.9}
DEFAULT_CONFIDENCE = 0.7
RRF_K = 60
# fixed values: predicates by their relationship
PREDICATE_EDGE_TYPES = {
    "licenses_to": "LICENSES_TO", "license": "LICENSES_TO", "licenses": "LICENSES_TO", "owns": "OWNS", "own": "OWNS", "assigns": "ASSIGNS", "assign": "ASSIGNS",
    "has_obligation": "HAS_OBLIGATION", "obligation": "HAS_OBLIGATION", "must": "HAS_OBLIGATION", "shall": "HAS_OBLIGATION",
    "subject_to_restriction": "SUBJECT_TO_RESTRICTION", "restricted": "SUBJECT_TO_RESTRICTION", "cannot": "SUBJECT_TO_RESTRICTION",
    "has_liability": "HAS_LIABILITY", "liability": "HAS_LIABILITY", "governed_by": "GOVERNED_BY", "governing_law": "GOVERNED_BY",
    "contains_clause": "CONTAINS_CLAUSE", "contains": "CONTAINS_CLAUSE", "effective_on": "EFFECTIVE_ON", "effective": "EFFECTIVE_ON",
    "terminates_on": "TERMINATES_ON", "expires": "TERMINATES_ON", "expiration": "TERMINATES_ON",
}
# fixed values: other names of types
ENTITY_TYPE_ALIASES = {
    "party": "Party", "ipasset": "IPAsset", "ip_asset": "IPAsset", "obligation": "Obligation", "restriction": "Restriction", "liabilityprovision": "LiabilityProvision",
    "liability_provision": "LiabilityProvision", "liability": "LiabilityProvision", "temporal": "Temporal", "date": "Temporal", "jurisdiction": "Jurisdiction",
    "contractclause": "ContractClause", "contract_clause": "ContractClause", "clause": "ContractClause", "contract": "Contract",
}
# fixed values: company forms, the first that fits
PARTY_SUFFIXES = [(" inc.", " Inc."), (" inc", " Inc."), (" llc", " LLC"), (" ltd", " Ltd."), (" ltd.", " Ltd."), (" corp.", " Corp."), (" corp", " Corp."), (" corporation", " Corporation"), (" company", " Company")]
# fixed values: phrases of questions, the first that fits
QUESTION_CATEGORIES = [
    ("document name", "Document Name"), ("parties", "Parties"), ("agreement date", "Agreement Date"), ("effective date", "Effective Date"), ("expiration date", "Expiration Date"),
    ("renewal term", "Renewal Term"), ("notice period to terminate renewal", "Notice Period To Terminate Renewal"), ("governing law", "Governing Law"), ("most favored nation", "Most Favored Nation"),
    ("non-compete", "Non-Compete"), ("exclusivity", "Exclusivity"), ("no-solicit of customers", "No-Solicit Of Customers"), ("no-solicit of employees", "No-Solicit Of Employees"),
    ("non-disparagement", "Non-Disparagement"), ("termination for convenience", "Termination For Convenience"), ("rofr/rofo/rofn", "Rofr/Rofo/Rofn"), ("change of control", "Change Of Control"),
    ("anti-assignment", "Anti-Assignment"), ("revenue/profit sharing", "Revenue/Profit Sharing"), ("price restriction", "Price Restrictions"), ("minimum commitment", "Minimum Commitment"),
    ("volume restriction", "Volume Restriction"), ("ip ownership assignment", "IP Ownership Assignment"), ("joint ip ownership", "Joint IP Ownership"), ("license grant", "License Grant"),
    ("non-transferable license", "Non-Transferable License"), ("affiliate license-licensor", "Affiliate License-Licensor"), ("affiliate license-licensee", "Affiliate License-Licensee"),
    ("unlimited/all-you-can-eat", "Unlimited/All-You-Can-Eat-License"), ("irrevocable or perpetual", "Irrevocable Or Perpetual License"), ("source code escrow", "Source Code Escrow"),
    ("post-termination services", "Post-Termination Services"), ("audit rights", "Audit Rights"), ("uncapped liability", "Uncapped Liability"), ("cap on liability", "Cap On Liability"),
    ("liquidated damages", "Liquidated Damages"), ("warranty duration", "Warranty Duration"), ("insurance", "Insurance"), ("covenant not to sue", "Covenant Not To Sue"),
    ("third party beneficiary", "Third Party Beneficiary"), ("competitive restriction exception", "Competitive Restriction Exception"),
]
# fixed values: what is asked of a clause of each label
EXTRACTION_TASKS = {
    "Parties": "Extract: party names, roles (licensor/licensee/vendor/customer), entity types (corporation/LLC/individual)",
    "Agreement Date": "Extract: the specific date the agreement was signed or executed",
    "Effective Date": "Extract: the specific date the contract becomes effective",
    "Expiration Date": "Extract: the specific expiration/end date or term length",
    "Renewal Term": "Extract: renewal period length, automatic vs manual renewal, number of renewals allowed",
    "Notice Period To Terminate Renewal": "Extract: number of days notice required, who must give notice",
    "Governing Law": "Extract: state/country governing the contract, jurisdiction for disputes",
    "License Grant": "Extract: type (exclusive/non-exclusive), scope, permitted uses, restrictions",
    "Irrevocable Or Perpetual License": "Extract: whether license is perpetual/irrevocable, any conditions",
    "Anti-Assignment": "Extract: assignment restrictions, consent requirements, exceptions",
    "Non-Compete": "Extract: duration, geographic scope, restricted activities",
    "Non-Disparagement": "Extract: scope of restriction, duration, consequences",
    "No-Solicit Of Employees": "Extract: duration, which employees covered, exceptions",
    "No-Solicit Of Customers": "Extract: duration, which customers covered, exceptions",
    "Exclusivity": "Extract: exclusive rights granted, scope, duration, territory",
    "Change Of Control": "Extract: what triggers change of control, consequences, notification requirements",
    "Cap On Liability": "Extract: liability cap amount/formula, what's covered, exceptions to cap",
    "Uncapped Liability": "Extract: what liabilities are uncapped, conditions",
    "Liquidated Damages": "Extract: damage amounts, triggering events, calculation method",
    "Revenue/Profit Sharing": "Extract: percentage splits, calculation method, payment timing",
    "Minimum Commitment": "Extract: minimum amounts, time periods, consequences of not meeting",
    "Audit Rights": "Extract: who can audit, frequency, notice required, scope",
    "Insurance": "Extract: coverage types required, minimum amounts, certificate requirements",
    "Warranty Duration": "Extract: warranty period length, what's covered, remedies",
    "Post-Termination Services": "Extract: services required, duration, pricing",
    "Termination For Convenience": "Extract: notice period, any penalties, conditions",
    "IP Ownership Assignment": "Extract: what IP is assigned, to whom, when assignment occurs",
    "Joint IP Ownership": "Extract: how joint ownership works, usage rights, commercialization",
    "Source Code Escrow": "Extract: escrow agent, release conditions, update requirements",
    "Third Party Beneficiary": "Extract: who the beneficiaries are, what rights they have",
    "Most Favored Nation": "Extract: what terms are covered, comparison mechanism",
    "Rofr/Rofo/Rofn": "Extract: type of right, what it applies to, exercise period",
}
# fixed values: what a portfolio is expected to have
STANDARD_PROTECTIONS = [
    "Cap On Liability", "Governing Law", "Termination For Convenience", "Notice Period To Terminate Renewal", "Warranty Duration",
    "Post-Termination Services", "Source Code Escrow", "Insurance", "Anti-Assignment", "Change Of Control",
]


def _sql(v: object) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).upper()
    if isinstance(v, float):
        return f"CAST({v!r} AS DOUBLE)"
    return str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"


def values(rows: list[tuple], *names: str) -> str:
    """A VALUES relation that Spark and other engines read alike."""
    body = ", ".join("(" + ", ".join(_sql(v) for v in r) + ")" for r in rows)
    return f"(SELECT * FROM (VALUES {body}) AS v({', '.join(names)}))"


DIMENSIONS: dict[str, str] = {
    "dim_label": values([(i, *r[:2]) for i, r in enumerate(LABELS)], "label_ord", "label", "category"),
    "dim_risk_rule": values([(i, r[0], r[2], r[3]) for i, r in enumerate(LABELS)], "label_ord", "label", "severity", "requires_llm"),
    "dim_missing_rule": values([(r[0], r[4]) for r in LABELS if r[4]], "label", "severity"),
    "dim_protection": values([(i, p) for i, p in enumerate(STANDARD_PROTECTIONS)], "protection_ord", "label"),
    "dim_severity": values(list(SEVERITY_WEIGHTS.items()), "severity", "weight"),
    "dim_dependency_rule": values([(i, *r) for i, r in enumerate(DEPENDENCY_RULES)], "rule_ord", "source", "target", "dependency_type", "strength", "bidirectional", "needs_validation"),
    "dim_threshold": values(list(AGGREGATION_THRESHOLDS.items()), "type", "threshold"),
    "dim_predicate": values(list(PREDICATE_EDGE_TYPES.items()), "predicate", "edge_type"),
    "dim_entity_type": values(list(ENTITY_TYPE_ALIASES.items()), "alias", "type"),
    "dim_node_type": values([(i, t) for i, t in enumerate(NODE_TYPES)], "type_ord", "type"),
    "dim_question": values([(i, *q) for i, q in enumerate(QUESTION_CATEGORIES)], "question_ord", "phrase", "label"),
    "dim_task": values(list(EXTRACTION_TASKS.items()), "label", "task"),
    "dim_pattern": values([(k, i, p) for k, v in LABEL_PATTERNS.items() for i, p in enumerate(v)], "label", "pattern_ord", "pattern"),
}


def dim(spark: SparkSession, name: str) -> DataFrame:
    """A dimension as a DataFrame; all are smaller than 200 rows."""
    return spark.sql(DIMENSIONS[name])


def label_rules(spark: SparkSession) -> DataFrame:
    """label, category, severity, requires_llm, high_risk, missing_severity (null where a lack is no risk) and the number of its patterns."""
    missing, patterns = dim(spark, "dim_missing_rule").withColumnRenamed("severity", "missing_severity"), dim(spark, "dim_pattern").groupBy("label").count().withColumnRenamed("count", "patterns")
    d = dim(spark, "dim_label").join(dim(spark, "dim_risk_rule").select("label", "severity", "requires_llm"), "label", "left").join(missing, "label", "left").join(patterns, "label", "left")
    return d.selectExpr("label", "category", "severity", "requires_llm", "coalesce(severity IN ('CRITICAL', 'HIGH'), false) AS high_risk", "missing_severity", "coalesce(patterns, 0L) AS patterns")
