"""The job market's skills: fixed values, in the order that decides between matches of equal length."""

#: Kind, then a line a skill: its name, and after a colon its patterns; without one its name in lower case is the only pattern.
SKILLS = r"""
language
Python
SQL
JavaScript
TypeScript
Java
Scala
Go: \bgolang\b  \bgo\s+programming\b  \blanguage\s+go\b
R: \br\s+programming\b  \bprogramming\s+in\s+r\b  \br\s+language\b  \brstudio\b  \btidyverse\b  \bggplot2\b  \bdplyr\b
Bash: \bbash\b  \bshell\s+scripting\b
Kotlin
Swift
Dart
Rust
PHP
Ruby
C#: \bc#\b  \bcsharp\b
C++: \bc\+\+
.NET: \b\.net\b  \bdotnet\b  \basp\.net\b
Julia
MATLAB

framework
React: \breact\b  \breact\.?js\b
Angular
Vue: \bvue\.?js\b  \bvue\s+(?:js|framework|component|3|2)\b
Next.js: \bnext\.?js\b
Django
FastAPI
Flask
Spring: \bspring\s+boot\b  \bspring\b
Node.js: \bnode\.?js\b  \bnode\b
Pandas
Polars
NumPy
Scikit-learn: \bscikit[-\s]?learn\b  \bsklearn\b
TensorFlow
PyTorch
Keras
Spark: \bapache\s+spark\b  \bpyspark\b  \bspark\b
Flink: \bapache\s+flink\b  \bflink\b
Hadoop
LangChain
LlamaIndex: \bllamaindex\b  \bllama[-\s]?index\b
SQLAlchemy
Celery
Pydantic
Flutter

cloud
AWS: \baws\b  \bamazon\s+web\s+services\b
Azure: \bazure\b  \bmicrosoft\s+azure\b
GCP: \bgcp\b  \bgoogle\s+cloud\b
Kubernetes: \bkubernetes\b  \bk8s\b
Docker
Terraform
Helm
Ansible

database
PostgreSQL: \bpostgresql\b  \bpostgres\b
MySQL
MongoDB: \bmongodb\b  \bmongo\b
Redis
Elasticsearch: \belasticsearch\b  \bopensearch\b
Cassandra
BigQuery
Snowflake
Databricks
Redshift
ClickHouse
SQL Server: \bsql\s+server\b  \bmssql\b
Oracle DB: \boracle\s+db\b  \boracle\s+database\b
DynamoDB
Neo4j
MariaDB
SQLite

tool
dbt
Airflow: \bairflow\b  \bapache\s+airflow\b
Prefect
Dagster
MLflow
Kafka: \bkafka\b  \bapache\s+kafka\b
Git
GitHub Actions: \bgithub\s+actions\b
GitHub
GitLab
Jenkins
Power BI: \bpower\s*bi\b
Tableau
Looker
Grafana
Prometheus
Hugging Face: \bhugging\s*face\b
OpenAI
Qlik: \bqlik\b  \bqlikview\b  \bqlik\s+sense\b
Metabase
Jira
Confluence
SonarQube
SonarLint
SonarCloud
Vault: \bhashicorp\s+vault\b  \bvault\b
Great Expectations: \bgreat\s+expectations\b
Spark Streaming: \bspark\s+streaming\b  \bstructured\s+streaming\b

methodology
CI/CD: \bci/cd\b  \bci-cd\b  \bcontinuous\s+integration\b  \bcontinuous\s+delivery\b  \bcontinuous\s+deployment\b
DevOps
MLOps
Agile
Scrum
REST API: \brest\s*api\b  \brestful\b
GraphQL
gRPC
Microservices: \bmicroservices?\b
TDD: \btdd\b  \btest[-\s]driven\s+development\b

tool
Linux: \blinux\b  \bubuntu\b  \bdebian\b  \brhel\b  \bcentos\b  \bfedora\b
Windows Server: \bwindows\s+server\b  \bwindows\s+active\s+directory\b
Active Directory: \bactive\s+directory\b  \bad\s+ds\b  \bldap\b

language
PowerShell
COBOL
VBA: \bvba\b  \bvisual\s+basic\s+for\s+applications\b

tool
Selenium
Playwright
Cypress
pytest
JUnit
Jest
Postman
Maven
Gradle

framework
NestJS: \bnestjs\b  \bnest\.?js\b
Express.js: \bexpress\.?js\b  \bexpressjs\b
Quarkus
Micronaut
Ktor
XGBoost
LightGBM
spaCy
OpenCV
NLTK

tool
RabbitMQ
ActiveMQ
Pulsar: \bapache\s+pulsar\b  \bpulsar\b
Nginx
Azure DevOps: \bazure\s+devops\b
Azure Data Factory: \bazure\s+data\s+factory\b  \badf\b

cloud
OpenShift

tool
ArgoCD: \bargcd\b  \bargo\s+cd\b
Bitbucket
CircleCI
Travis CI: \btravis\s+ci\b
Datadog
Kibana
Splunk
New Relic: \bnew\s+relic\b
Dynatrace

methodology
OpenAPI: \bopenapi\b  \bswagger\b

tool
SharePoint
ServiceNow
Salesforce
Zendesk
Talend
SSIS: \bssis\b  \bsql\s+server\s+integration\s+services\b
Informatica
Airbyte
Delta Lake: \bdelta\s+lake\b
Debezium
Apache Iceberg: \biceberg\b  \bapache\s+iceberg\b
dbt Cloud: \bdbt\s+cloud\b
Fivetran
Stitch: \bstitch\s+data\b

database
Pinecone
Weaviate
Qdrant
Milvus

cloud
AWS Lambda: \baws\s+lambda\b  \blambda\s+function\b
AWS S3: \baws\s+s3\b  \bamazon\s+s3\b
Azure Synapse: \bazure\s+synapse\b

database
Google BigQuery: \bgoogle\s+bigquery\b

cloud
Vertex AI: \bvertex\s+ai\b
SageMaker
"""


def listed(text: str = SKILLS) -> tuple[tuple[str, str, tuple[str, ...]], ...]:
    """(name, kind, patterns) in order."""
    out = []
    for block in text.strip().split("\n\n"):
        kind, *lines = block.split("\n")
        for line in lines:
            name, _, patterns = line.partition(": ")
            out.append((name, kind, tuple(patterns.split("  ")) if patterns else (rf"\b{name.lower()}\b",)))
    return tuple(out)
