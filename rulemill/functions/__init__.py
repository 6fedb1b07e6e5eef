"""Part of rulemill."""
