"""Invented candidate profiles: each document with the résumé-like lines that its id picks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from .registry import lit, sql_list, table

SNIPPETS = [
    "Ana Petrova Silva\nSummary\nSenior engineer with 5+ years of experience\nTechnical Skills\npython, sql, docker and machine learning\nWork Experience\nBuilt data pipelines 2019 - 2023 with python\nProjects\n- Realtime ranking service written in python with sql storage and docker\nEducation\nBachelor of Technology in computer science cgpa 8.5 10",
    "Ben Osei\nSkills\njava, spring, mysql\nExperience\n3 years experience in backend work at Acme 2021 2024\nProjects\n1. Payment gateway project with spring and kafka queues for many shops\nEducation\nmaster of science information technology 3.72 4.00",
    "Chloe Martin\nEDUCATION\nphd statistics\nAwards\nbest thesis 2016\nAchievements\nnone",
    "Dev Kumar\nmust have: react and javascript. nice to have: docker, kubernetes\nlead of a team, 12 years of experience\nProjects\n• Dashboard project with react and node for hospital staff, used daily",
    "Eva Lind\ncontact eva.lind@example.org\nCertification\naws\nINTERNSHIP\ncloud internship 2024, 0 72 gpa 9 00",
    "Farid\nwe are looking for linux, git and c++ skills. required: linux. bonus: python\nQualification: diploma, mech",
    "G. H.\nExtracurricular\nchess club\nLeadership\ncaptain\nSkills\nml, nlp and ts",
    "Hana Sato\n2 yrs of experience, deep learning and computer vision with tensorflow and pytorch\nEducation\nm.tech ai 85.0 100",
    "Ivo Novak\nEmployment History\ntester, unit testing and security 2015 2018\nPortfolio\nsmall tools",
    "Jo\nmandatory: mongodb; good to have: redis\nbsc physics\nJan 2023 - Mar 2024",
    "Kim Park\nData analytics, etl and data warehouse on azure; project experience\n- Warehouse loading with etl jobs, sql and monitoring of 40 tables each night\n- Small",
    "Lena Roth\nPublications\nthree papers on big data\nTechnical Skills\nscala; go; rest api and microservices 1.5 years",
]
SKILLS = ["python", "sql", "docker", "machine learning", "java", "spring", "react", "linux", "aws", "kafka"]
#: What the query document asks for.
JD = "Senior data engineer. Must have python, sql and docker; machine learning required. Nice to have: kafka, aws. 4 years of experience and a bachelor of technology in computer science."
JD_SKILLS = ["Python", "SQL", "Docker", "ML", "Kafka", "AWS"]

PROFILES_SQL = f"p AS (SELECT doc_id, coalesce(text, '') || chr(10) || ({sql_list(SNIPPETS)})[doc_id % {len(SNIPPETS)} + 1] AS text, ({sql_list(SNIPPETS)})[doc_id % {len(SNIPPETS)} + 1] AS snippet FROM documents)"


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    snippet = F.get(X.strings(SNIPPETS), (F.col("doc_id") % len(SNIPPETS)).cast("int"))
    return docs.select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), snippet).alias("text"), snippet.alias("snippet"))


def sql_text() -> str:
    return lit(JD)
