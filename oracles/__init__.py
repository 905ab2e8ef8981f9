"""DuckDB SQL that states, independently of the engine, what each registered query must return."""
