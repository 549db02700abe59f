"""Label set, column-name pools, enumerations and thresholds.

Everything in this module is a value that results depend on, not logic.
"""

from __future__ import annotations

# The ten labels, in id order.
LABELS = [
    "ADDRESS", "BANK_ACCOUNT", "CREDIT_CARD", "DATE_OF_BIRTH", "EMAIL",
    "FULL_NAME", "NONE", "PASSPORT", "PHONE", "SSN",
]
LABEL_TO_ID = {label: i for i, label in enumerate(LABELS)}
ID_TO_LABEL = dict(enumerate(LABELS))

# Event enumerations.
SOURCE_TYPES = ["athena", "glue", "s3_parquet", "s3_csv", "s3_json", "unknown"]
FILE_FORMATS = ["parquet", "csv", "json", "orc", "avro", "unknown"]
EXTENSION_FORMATS = {
    ".parquet": "parquet", ".csv": "csv", ".json": "json", ".orc": "orc", ".avro": "avro",
}
FORMAT_SOURCE_TYPES = {"parquet": "s3_parquet", "csv": "s3_csv", "json": "s3_json"}

# Thresholds and retention periods.
FLAG_THRESHOLD = 0.85
FIXTURE_GATE = 0.95
F1_GATE = 0.90
SAMPLE_ROWS = 1000
VALUES_PER_COLUMN = 10
QUARANTINE_DAYS = 30
WARNING_DAYS_BEFORE = 7
LAG_WARNING = 50_000
LAG_CRITICAL = 200_000
RATE_WINDOW_SECONDS = 60
CASCADE_CONFIDENCE = 0.7
NOTICE_FINDINGS = 20

# Histogram bounds in seconds.
PROCESSING_BOUNDS = [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5]
INFERENCE_BOUNDS = [0.05, 0.1, 0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 5.0, 10.0]
SAMPLING_BOUNDS = [5.0, 15.0, 30.0, 60.0, 120.0, 300.0, 600.0]

# Legal bases of a processing register.
LEGAL_BASES = [
    "Contract performance", "Legal obligation", "Legitimate interest",
    "Consent", "Vital interests", "Public task",
]

# Statuses.
DONE_STATUSES = ["remediated", "quarantined"]
COMPLETION_EVENTS = ["anonymization_completed", "quarantine_completed"]
MANUAL_ACTIONS = ["anonymize", "quarantine", "false_positive"]
LEGAL_TRANSITIONS = [
    ("pending", "queued"), ("queued", "sampling"), ("sampling", "sampled"),
    ("sampled", "flagged"), ("sampled", "classified"), ("classified", "flagged"),
]

# Data-subject identifier types.
IDENTIFIER_CATEGORIES = {"email": "EMAIL", "national_id": "SSN", "phone": "PHONE"}

# Name parts that mark a source as a copy of another one.
CHILD_KEYWORDS = [
    "backup", "copy", "dump", "staging", "dev", "test",
    "temp", "archive", "export", "sample", "snapshot",
]

# Column names typical for each label (three locales).
COLUMN_NAMES = {
    "SSN": [
        "ssn", "social_security_number", "social_security_no", "ss_number", "num_seguro_social",
        "numero_seguro_social", "cpf_equivalent", "sin", "tax_id_us",
    ],
    "CREDIT_CARD": [
        "credit_card", "card_number", "cc_number", "credit_card_number", "payment_card", "card_no",
        "numero_tarjeta", "numero_cartao", "card_num", "pan",
    ],
    "EMAIL": [
        "email", "email_address", "correo", "correo_electronico", "e_mail", "email_addr",
        "user_email", "contact_email", "endereço_email", "email_contato",
    ],
    "PHONE": [
        "phone", "phone_number", "telefone", "telefono", "cel", "celular", "mobile",
        "mobile_number", "contact_phone", "numero_telefone", "fone", "phone_no",
    ],
    "FULL_NAME": [
        "full_name", "name", "customer_name", "nome", "nombre", "nombre_completo",
        "nome_completo", "person_name", "client_name", "user_name", "display_name", "legal_name",
    ],
    "DATE_OF_BIRTH": [
        "date_of_birth", "dob", "birth_date", "birthdate", "fecha_nacimiento", "data_nascimento",
        "birthday", "born_on", "dt_nasc", "fecha_de_nacimiento", "dt_nascimento",
    ],
    "ADDRESS": [
        "address", "street_address", "mailing_address", "home_address", "direccion", "endereço",
        "endereco", "residential_address", "billing_address", "shipping_address", "domicilio",
    ],
    "BANK_ACCOUNT": [
        "bank_account", "account_number", "iban", "bank_account_number", "conta_bancaria",
        "numero_cuenta", "conta_corrente", "account_no", "bank_acc", "routing_account",
    ],
    "PASSPORT": [
        "passport", "passport_number", "passport_no", "numero_pasaporte", "numero_passaporte",
        "passport_id", "travel_document", "passport_num", "doc_viaje",
    ],
    "NONE": [
        "id", "product_id", "order_id", "quantity", "price", "status", "created_at", "updated_at",
        "category", "sku", "score", "rating", "count", "amount", "description", "notes", "code",
        "region", "country_code", "currency", "tax_rate", "weight",
    ],
}

REDACTED = "[REDACTED]"
