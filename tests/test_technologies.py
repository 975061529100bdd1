"""Technologies from source files and manifests."""

from tessera.operators import code, stack

JAVA = "package p;\nimport org.springframework.cloud.openfeign.FeignClient;\nimport org.springframework.Foo;\nimport org.springframeworkx.Bar;\nimport org.apache.ibatis.*;\n@RestController\n@TableName(\"t\")\nclass A { }\n"
POM = "<project>\n<properties><m>3.5</m></properties>\n<dependency><groupId>g</groupId><artifactId>mybatis-plus-core</artifactId><version>${m}</version></dependency>\n<dependency><groupId>g</groupId><artifactId>spring-boot-starter-web</artifactId></dependency>\n<dependency><groupId>g</groupId><artifactId>guava</artifactId><version>${no}</version></dependency>\n</project>"


def test_detected(spark):
    rows = [(1, "a/A.java", JAVA), (1, "pom.xml", POM), (1, "w/package.json", '{"name": "vue", "dependencies": {"vue": "^3.4", "left-pad": "1"}, "devDependencies": {"vite": " "}}'), (1, "requirements.txt", "Flask==2.0\nnumpy>=1\nodd==3\n"), (2, "x.txt", "flask==1")]
    files = spark.createDataFrame(rows, "project_id long, file_path string, content string")
    f = code.facts(files.filter("file_path like '%.java'"))
    known, evidence, unknown = stack.technologies(stack.names_of(f.types, f.imports, files))
    assert {(r.project_id, r.category, r["stack"], r.version) for r in known.collect()} == {
        (1, "BACKEND", "Spring Cloud OpenFeign", None), (1, "BACKEND", "Spring Framework", None), (1, "PERSISTENCE", "MyBatis", None), (1, "BACKEND", "Spring MVC", None), (1, "PERSISTENCE", "MyBatis-Plus", "3.5"),
        (1, "BACKEND", "Spring Boot", None), (1, "FRONTEND", "Vue", "3.4"), (1, "FRONTEND", "Vite", None), (1, "BACKEND", "Flask", "2.0"), (1, "TOOL", "numpy", None),
    }
    assert [r.evidence for r in evidence.filter("stack in ('MyBatis-Plus', 'Spring MVC')").orderBy("stack", "nth").collect()] == [
        "a/A.java: @TableName on A", "pom.xml: g:mybatis-plus-core:3.5", "a/A.java: @RestController on A", "pom.xml: g:spring-boot-starter-web"
    ]
    assert {r.dependency for r in unknown.collect()} == {"g:guava", "left-pad@1", "odd==3"}
