"""Figures of the marketplace model; every function takes those it uses as overridable arguments."""

# fixed values
BASE_RATE = 0.7947
BASE_WEIGHT = 10.0
MAX_DELTA = 2.0
WEIGHTS = {"provisional": 0.5, "graduated": 1.0}
HIRE_AT = 0.5
MIN_SUPPORT, MIN_DELTA, TRIAL = 5, 0.20, 10
LEDGER_SUPPORT, LEDGER_TARGET, BIN_SUPPORT = 200, 0.5, 20
RESPONSE_PRIOR, RESPONSE_WEIGHT = 0.4669, 5.0
HALF_LIFE, EXPIRY = 43_200, 216_000
CONFIRMATIONS = 30
TABLE_SUPPORT = 150
ERROR_GAP = 0.5
MAX_WORDS = 2000

#: Blocks of one bucket of a two-level running sum.
BUCKET_BLOCKS = 1024

# fixed values: the ladder of conditions, in order; booleans compare as 0 and 1
LADDER = (
    ("amount", ">", 10_000.0),
    ("amount", ">", 50_000.0),
    ("amount", ">", 100_000.0),
    ("amount", ">", 200_000.0),
    ("amount", ">", 500_000.0),
    ("amount", ">", 1_000_000.0),
    ("repeat_pair", "==", 1.0),
    ("repeat_pair", "==", 0.0),
    ("budget_set_count", ">", 1.0),
    ("client_prior_funding_rate", "<", 0.25),
    ("client_prior_funding_rate", "<", 0.5),
    ("client_prior_funding_rate", "<", 0.75),
    ("client_prior_created", "==", 0.0),
    ("pair_prior_jobs", ">=", 3.0),
    ("provider_concurrent_open", ">", 1.0),
    ("provider_concurrent_open", ">", 3.0),
    ("provider_concurrent_open", ">", 10.0),
    ("expiry_window", "<", 3_600.0),
    ("expiry_window", "<", 21_600.0),
    ("expiry_window", "<", 86_400.0),
)
FIELDS = tuple(dict.fromkeys(f for f, _, _ in LADDER))

# fixed values: event signatures
SIGNATURES = {
    "JobCreated": "0xb0f0239bfdd96453e24733e18bfc24b70d8fadf123dd977473518dd577ee79b9",
    "BudgetSet": "0x869e2577b006bf47ee981cf6fec2e25583548081c14b98deab587f77b5068038",
    "JobFunded": "0xe3fbcc1ea1bdc559ec7f0347efde7655e58b5f45a30b0e4470a583c3ef5496b3",
    "JobSubmitted": "0x80c17db79857f338a6a6df68a6883ecc0ce78e2202fe61ed979733573f40538e",
    "JobCompleted": "0x0fd54bd364fa9e67f17b091aefe930932c09fe7651cf5ad02c71a418f3341444",
    "PaymentReleased": "0x21d71db5be59bb9fa133895586b7404307dd33fb93b16db09dc6f1d9d7d231b0",
    "EvaluatorFeePaid": "0x253dd534010ac976fa263caa123bae79b9c50292adf7ce67bdc5ec309f784e61",
    "Refunded": "0x7ca5472b7ea78c2c0141c5a12ee6d170cf4ce8ed06be3d22c8252ddfc7a6a2c4",
    "JobExpired": "0x97237956f8810192811e2c3f273fd02c5d6295206fdd9c62e6fe2bfc19ba9232",
    "JobRejected": "0xae7362b1af91f4492868987b9c73990d780060811551b58728fbe96fd1bab275",
}
FAILURES = ("JobRejected", "Refunded", "JobExpired")
TERMINAL = ("JobCompleted", *FAILURES)
UNANSWERED_ENDS = ("JobExpired", "JobRejected")
