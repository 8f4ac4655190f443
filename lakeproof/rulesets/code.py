"""Rules for scanning and rewriting job code."""

from __future__ import annotations

# Hit kinds of a dependency scan, in reporting order, with the job type they report.
# The flag i ignores case.
DEPENDENCY_PATTERNS = (
    ("storage_path", "SPARK", r"s3://[\w\-./]+", ""),
    ("query_operator", "AIRFLOW_DAG", r"\b(?:AthenaOperator|AwsAthenaOperator)\b", ""),
    ("map_type", "SPARK",
     r"\b(?:MapType|StructField)\b.*\bmap\b|\bmap\b.*\b(?:MapType|StructField)\b", "i"),
    ("query_client", "LAMBDA", r"""boto3\.client\(\s*['"]athena['"]\s*\)""", ""),
)
REWRITE_JOB_TYPES = ("LAMBDA", "AIRFLOW_DAG")

# Code classes, in the order they are tested; the last one is the rest.
REMOTE_CODE = (
    r"\b(?:import|class|public|private|protected)\b|https?://|require\s*\(|from\s+\S+\s+import"
)
JS_CODE = r"\b(?:var|let|const|function)\b|=>|JSON\.parse|JSON\.stringify|console\.log"
CODE_CLASSES = ("CLOUD_RUN_REMOTE", "JS_UDF", "SQL_UDF")

# Module paths, operator class names and the storage scheme, old to new.
MODULE_PATHS = {
    "airflow.providers.amazon.aws.operators.athena": "airflow.providers.google.cloud.operators.bigquery",
    "airflow.providers.amazon.aws.operators.emr": "airflow.providers.google.cloud.operators.dataproc",
    "airflow.providers.amazon.aws.sensors.s3": "airflow.providers.google.cloud.sensors.gcs",
    "airflow.providers.amazon.aws.operators.emr_add_steps": "airflow.providers.google.cloud.operators.dataproc",
    "airflow.providers.amazon.aws.operators.emr_create_job_flow": "airflow.providers.google.cloud.operators.dataproc",
    "airflow.providers.amazon.aws.sensors.s3_key": "airflow.providers.google.cloud.sensors.gcs",
}
OPERATOR_NAMES = {
    "AthenaOperator": "BigQueryInsertJobOperator",
    "AwsAthenaOperator": "BigQueryInsertJobOperator",
    "EmrAddStepsOperator": "DataprocSubmitJobOperator",
    "EmrCreateJobFlowOperator": "DataprocSubmitJobOperator",
    "S3KeySensor": "GCSObjectExistenceSensor",
}
STORAGE_SCHEMES = {"s3://": "gs://"}
