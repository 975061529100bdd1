"""What names say about the technologies of a project."""

# Technologies by category, in the order of categories.
CATEGORIES = {
    "BACKEND": ("Spring Framework", "Spring Boot", "Spring MVC", "Spring Cloud", "Spring Cloud OpenFeign", "Spring AOP", "LangGraph4j", "FastAPI", "Flask", "Django"),
    "PERSISTENCE": ("MyBatis", "MyBatis-Plus", "Hibernate", "Spring Data JPA", "MapStruct", "SQLAlchemy"),
    "DATABASE": ("MySQL", "PostgreSQL", "MongoDB"),
    "MIDDLEWARE": ("Redis", "RabbitMQ", "Kafka", "Nacos", "Sentinel", "MinIO", "Elasticsearch"),
    "SECURITY": ("Spring Security", "Apache Shiro"),
    "FRONTEND": ("Vue", "Vue Router", "Pinia", "Vuex", "React", "Element Plus", "Ant Design Vue", "Axios", "ECharts", "Vite", "TypeScript"),
    "TEST": ("JUnit 5", "Mockito", "pytest"),
    "TOOL": ("Lombok", "Flyway", "SpringDoc OpenAPI", "Tree-Sitter", "JGit", "pandas", "numpy", "pydantic"),
}

# Prefixes of imported names, which end at a dot.
IMPORTS = {
    "org.springframework.boot": "Spring Boot", "org.springframework.cloud.openfeign": "Spring Cloud OpenFeign", "org.springframework.cloud": "Spring Cloud",
    "org.springframework.web": "Spring MVC", "org.springframework.security": "Spring Security", "org.springframework.data.jpa": "Spring Data JPA",
    "org.springframework.data.redis": "Redis", "org.springframework.amqp": "RabbitMQ", "org.springframework.kafka": "Kafka", "org.springframework.aop": "Spring AOP",
    "org.springframework.stereotype": "Spring Framework", "org.springframework.context": "Spring Framework", "org.springframework.beans": "Spring Framework",
    "org.springframework.core": "Spring Framework", "org.springframework": "Spring Framework",
    "com.baomidou.mybatisplus": "MyBatis-Plus", "org.apache.ibatis": "MyBatis", "org.mybatis": "MyBatis", "org.hibernate": "Hibernate", "org.mapstruct": "MapStruct",
    "org.apache.shiro": "Apache Shiro", "org.aspectj": "Spring AOP", "lombok": "Lombok", "org.junit.jupiter": "JUnit 5", "org.mockito": "Mockito",
    "com.alibaba.nacos": "Nacos", "com.alibaba.csp.sentinel": "Sentinel", "com.rabbitmq": "RabbitMQ", "org.apache.kafka": "Kafka", "redis.clients": "Redis", "io.minio": "MinIO",
    "org.elasticsearch": "Elasticsearch", "com.mongodb": "MongoDB", "org.flywaydb": "Flyway", "org.springdoc": "SpringDoc OpenAPI", "org.treesitter": "Tree-Sitter",
    "org.eclipse.jgit": "JGit", "org.bsc.langgraph4j": "LangGraph4j",
}

# Annotations.
ANNOTATIONS = {
    "SpringBootApplication": "Spring Boot", "ConfigurationProperties": "Spring Boot", "EnableConfigurationProperties": "Spring Boot",
    "RestController": "Spring MVC", "Controller": "Spring MVC", "RestControllerAdvice": "Spring MVC", "ControllerAdvice": "Spring MVC", "RequestMapping": "Spring MVC",
    "GetMapping": "Spring MVC", "PostMapping": "Spring MVC", "PutMapping": "Spring MVC", "DeleteMapping": "Spring MVC",
    "FeignClient": "Spring Cloud OpenFeign", "Aspect": "Spring AOP",
    "Service": "Spring Framework", "Component": "Spring Framework", "Repository": "Spring Framework", "Configuration": "Spring Framework", "Bean": "Spring Framework",
    "Autowired": "Spring Framework", "Scheduled": "Spring Framework",
    "TableName": "MyBatis-Plus", "TableId": "MyBatis-Plus", "TableField": "MyBatis-Plus", "TableLogic": "MyBatis-Plus",
}

# Artifacts by their whole name; one may say several technologies.
ARTIFACTS = {
    "spring-boot-starter-parent": ("Spring Boot",), "spring-boot-maven-plugin": ("Spring Boot",), "spring-boot-starter": ("Spring Boot",),
    "spring-boot-starter-web": ("Spring Boot", "Spring MVC"), "spring-boot-starter-validation": ("Spring Boot",), "spring-boot-starter-actuator": ("Spring Boot",),
    "spring-boot-starter-aop": ("Spring Boot", "Spring AOP"), "spring-boot-starter-test": ("Spring Boot", "JUnit 5"), "spring-boot-starter-data-jpa": ("Spring Boot", "Spring Data JPA"),
    "spring-boot-starter-data-redis": ("Spring Boot", "Redis"), "spring-boot-starter-amqp": ("Spring Boot", "RabbitMQ"), "spring-boot-starter-security": ("Spring Boot", "Spring Security"),
    "spring-boot-starter-data-mongodb": ("Spring Boot", "MongoDB"),
    "spring-cloud-dependencies": ("Spring Cloud",), "spring-cloud-alibaba-dependencies": ("Spring Cloud",), "spring-cloud-starter-gateway": ("Spring Cloud",),
    "spring-cloud-starter-openfeign": ("Spring Cloud", "Spring Cloud OpenFeign"), "spring-cloud-starter-alibaba-nacos-discovery": ("Spring Cloud", "Nacos"),
    "spring-cloud-starter-alibaba-nacos-config": ("Spring Cloud", "Nacos"), "spring-cloud-starter-alibaba-sentinel": ("Spring Cloud", "Sentinel"),
    "mybatis-plus-boot-starter": ("MyBatis-Plus",), "mybatis-spring-boot-starter": ("MyBatis",), "mybatis-plus-extension": ("MyBatis-Plus",), "hibernate-core": ("Hibernate",),
    "mapstruct": ("MapStruct",), "shiro-spring-boot-web-starter": ("Apache Shiro",), "lombok": ("Lombok",),
    "mysql-connector-j": ("MySQL",), "mysql-connector-java": ("MySQL",), "postgresql": ("PostgreSQL",), "flyway-core": ("Flyway",), "minio": ("MinIO",),
    "springdoc-openapi-starter-webmvc-ui": ("SpringDoc OpenAPI",), "langgraph4j-core": ("LangGraph4j",), "tree-sitter": ("Tree-Sitter",), "tree-sitter-java": ("Tree-Sitter",),
    "org.eclipse.jgit": ("JGit",),
}

# Beginnings of artifacts that have no name of their own above.
FAMILIES = {
    "spring-cloud-starter-alibaba-nacos": ("Spring Cloud", "Nacos"), "spring-cloud-starter-alibaba-sentinel": ("Spring Cloud", "Sentinel"), "spring-cloud-": ("Spring Cloud",),
    "spring-boot-starter-data-redis": ("Spring Boot", "Redis"), "spring-boot-": ("Spring Boot",), "spring-security-": ("Spring Security",), "spring-data-jpa": ("Spring Data JPA",),
    "mybatis-plus-": ("MyBatis-Plus",), "mybatis-": ("MyBatis",), "shiro-": ("Apache Shiro",), "nacos-": ("Nacos",), "sentinel-": ("Sentinel",), "junit-jupiter": ("JUnit 5",),
    "mockito-": ("Mockito",), "flyway-": ("Flyway",), "springdoc-": ("SpringDoc OpenAPI",), "tree-sitter": ("Tree-Sitter",), "langgraph4j": ("LangGraph4j",),
    "jedis": ("Redis",), "lettuce-": ("Redis",), "redisson-": ("Redis",), "kafka-": ("Kafka",), "amqp-client": ("RabbitMQ",), "mongodb-driver": ("MongoDB",), "elasticsearch": ("Elasticsearch",),
}

# Packages of package.json and of requirements.
NPM_PACKAGES = {
    "vue": "Vue", "vue-router": "Vue Router", "pinia": "Pinia", "vuex": "Vuex", "react": "React", "element-plus": "Element Plus", "ant-design-vue": "Ant Design Vue", "axios": "Axios",
    "echarts": "ECharts", "vite": "Vite", "typescript": "TypeScript",
}
PYTHON_PACKAGES = {"fastapi": "FastAPI", "flask": "Flask", "django": "Django", "pydantic": "pydantic", "sqlalchemy": "SQLAlchemy", "pandas": "pandas", "numpy": "numpy", "pytest": "pytest"}

#: All rules as rows (kind, key, technologies).
RULES = [
    (kind, key, (says,) if isinstance(says, str) else says)
    for kind, rules in (("import", IMPORTS), ("annotation", ANNOTATIONS), ("artifact", ARTIFACTS), ("family", FAMILIES), ("npm", NPM_PACKAGES), ("python", PYTHON_PACKAGES))
    for key, says in rules.items()
]
CATEGORY_OF = {t: c for c, known in CATEGORIES.items() for t in known}
