"""Readers and normalisers that turn raw tables into typed ones."""
