"""Nested infrastructure formats: paths of indented files, compose, manifests, Terraform."""

from conftest import rows
from weft.operators import infra

COMPOSE = """# stack
services:
  web:
    image: "ghcr.io/a/web:1.2"   # pinned
    ports:
      - "8080:80"
      - target: 9000
    environment:
      - KEY=secret
      - MODE
    deploy:
      replicas: 3
  db:
    build: .
    environment:
      POSTGRES_DB: x
volumes:
  data:
    driver: local
secrets:
  token: { file: ./t }
"""
K8S = """apiVersion: apps/v1
kind: Deployment
metadata:
  name: web
spec:
  replicas: 2
  template:
    spec:
      containers:
      - name: app
        image: r.io:5000/app:2.0
        ports:
        - containerPort: 8080
        env:
        - name: TOKEN
          value: "name: no"
      - image: side
        name: side
---
apiVersion: v1
kind: Secret
metadata: {}
data:
  kind: Service
---
apiVersion: v1
kind: Service
metadata:
  name: svc
"""
TF = """# resource "aws_no" "no" {}
resource "aws_s3_bucket" "b" {
  bucket = "resource \\"x\\" \\"y\\" {"
  tags = { a = 1 }
}
data "aws_ami" "img" {}
module "net" {
  source = "./net"
  cidr   = "10.0.0.0/8"
  zones = ["a"]
}
variable "region" {}
output "id" { value = 1 }
provider "aws" {}
"""


def test_paths(spark):
    text = "a:\n  b: 1 # c\n  l:\n  - x: 'q'\n    y: \"z\"\n  - plain\n\nd: |\n  text\n---\na: 2\n"
    got = rows(infra.yaml_paths(spark.createDataFrame([("f.yml", text), ("n.yml", None), ("e.yml", "")], "file string, text string")).select("doc", "line", "path", "value"))
    want = [(0, 1, ".a", None), (0, 2, ".a.b", "1"), (0, 3, ".a.l", None), (0, 4, ".a.l.[]", None), (0, 4, ".a.l.[].x", "q"), (0, 5, ".a.l.[].y", "z"), (0, 6, ".a.l.[]", "plain"), (0, 8, ".d", "|"), (1, 11, ".a", "2")]
    assert got == sorted(want, key=repr)


def test_rows(spark):
    files = spark.createDataFrame([("docker-compose.yml", COMPOSE), ("k/web.yaml", K8S), ("m/main.tf", TF), ("composer.yml", "services:\n  no:\n    image: x"), ("null.tf", None)], "file string, text string")
    got = {(r.file.split("/")[-1], r.kind, r.type, r.name): (r.line, r.image, r.tag, r.ports, r.replicas, r.variables) for r in infra.infra_rows(files).collect()}
    assert got == {
        ("docker-compose.yml", "workload", "compose-service", "web"): (3, "ghcr.io/a/web", "1.2", ["80", "9000"], "3", ["KEY", "MODE"]),
        ("docker-compose.yml", "workload", "compose-service", "db"): (13, None, None, [], None, ["POSTGRES_DB"]),
        ("docker-compose.yml", "volume", "compose-volume", "data"): (18, None, None, None, None, None),
        ("docker-compose.yml", "secret", "compose-secret", "token"): (21, None, None, None, None, None),
        ("web.yaml", "workload", "Deployment", "web"): (2, None, None, None, "2", None),
        ("web.yaml", "image", "container", "app"): (11, "r.io:5000/app", "2.0", ["8080"], None, ["TOKEN"]),
        ("web.yaml", "image", "container", "side"): (17, "side", None, [], None, []),
        ("web.yaml", "secret", "Secret", None): (21, None, None, None, None, None),
        ("web.yaml", "service", "Service", "svc"): (27, None, None, None, None, None),
        ("main.tf", "resource", "aws_s3_bucket", "b"): (2, None, None, None, None, None),
        ("main.tf", "resource", "data.aws_ami", "img"): (6, None, None, None, None, None),
        ("main.tf", "module", "module", "net"): (7, None, None, None, None, ["cidr", "zones"]),
        ("main.tf", "variable", "variable", "region"): (12, None, None, None, None, None),
        ("main.tf", "output", "output", "id"): (13, None, None, None, None, None),
        ("main.tf", "provider", "provider", "aws"): (14, None, None, None, None, None),
    }
