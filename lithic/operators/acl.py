"""Access control with grantors: delegated grants, cascading revokes, owners, and the sections of a baseline (ACL-1, 4, 5, 10, 12)."""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame

from lithic.sources.sinks import grant, quoted

# The privileges of each class of object, and what PUBLIC has from the start.
UNIVERSE = {
    "TABLE": ["SELECT", "INSERT", "UPDATE", "DELETE", "TRUNCATE", "REFERENCES", "TRIGGER", "MAINTAIN"], "SEQUENCE": ["USAGE", "SELECT", "UPDATE"], "COLUMN": ["SELECT", "INSERT", "UPDATE", "REFERENCES"],
    "FUNCTION": ["EXECUTE"], "SCHEMA": ["USAGE", "CREATE"], "TYPE": ["USAGE"],
}
PUBLIC = {"FUNCTION": ["EXECUTE"], "TYPE": ["USAGE"]}


class Acl:
    """One object's privileges: (grantee, privilege) -> {grantor: with grant option}."""

    def __init__(self, kind: str, owner: str) -> None:
        self.kind, self.owner, self.held = kind, owner, defaultdict(dict)
        for p in PUBLIC.get(kind, []):
            self.held["public", p][owner] = False

    def may_grant(self, role: str, privilege: str) -> bool:
        return role == self.owner or any(self.held.get((role, privilege), {}).values())

    def grant(self, grantor: str, grantee: str, privilege: str, option: bool) -> bool:
        """False, and no change, if the grantor may not."""
        if not self.may_grant(grantor, privilege):
            return False
        by = self.held[grantee, privilege]
        by[grantor] = by.get(grantor, False) or option
        return True

    def revoke(self, grantor: str, grantee: str, privilege: str, option_only: bool) -> None:
        """Takes back what this grantor gave, and what the grantee could pass on only because of it."""
        by = self.held.get((grantee, privilege), {})
        if grantor not in by:
            return
        if option_only:
            by[grantor] = False
        else:
            del by[grantor]
        if not self.may_grant(grantee, privilege):
            for (other, p), given in list(self.held.items()):
                if p == privilege and grantee in given and other != grantee:
                    self.revoke(grantee, other, privilege, False)

    def change_owner(self, new: str) -> None:
        """What the old owner held or gave is the new owner's."""
        merged = defaultdict(dict)
        for (grantee, p), by in self.held.items():
            target = merged[new if grantee == self.owner else grantee, p]
            for g, option in by.items():
                g = new if g == self.owner else g
                target[g] = target.get(g, False) or option
        self.held, self.owner = merged, new

    def net(self) -> list[tuple[str, str, bool]]:
        return sorted((g, p, any(by.values())) for (g, p), by in self.held.items() if by and g != self.owner)


def replay(log: DataFrame) -> DataFrame:
    """ACL-5. Net (object, grantee, privilege, grant_option) after (object, kind, pos, action, grantor, grantee, privilege, option) in order of pos.

    Actions: CREATE (grantor owns), DROP, OWNER (grantee takes over), GRANT, REVOKE. ALL stands for the class's privileges.
    Objects are independent; each object's history is folded by itself. Histories before a CREATE count as the owner "owner"'s.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        acl, first = None, pdf.iloc[0]
        for r in pdf.sort_values("pos").itertuples(index=False):
            if r.action == "DROP":
                acl = None
                continue
            if acl is None or r.action == "CREATE":
                acl = Acl(r.kind, r.grantor if r.action == "CREATE" else "owner")
            if r.action == "OWNER":
                acl.change_owner(r.grantee)
            for p in (UNIVERSE.get(r.kind, []) if r.privilege == "ALL" else [r.privilege]) if r.action in ("GRANT", "REVOKE") else []:
                if r.action == "GRANT":
                    acl.grant(r.grantor, r.grantee, p, bool(r.option))
                else:
                    acl.revoke(r.grantor, r.grantee, p, bool(r.option))
        rows = [(first.object, *n) for n in acl.net()] if acl else []
        return pd.DataFrame(rows, columns=["object", "grantee", "privilege", "grant_option"])

    columns = ["object", "kind", "pos", "action", "grantor", "grantee", "privilege", "option"]
    return log.select(columns).groupBy("object").applyInPandas(one, "object string, grantee string, privilege string, grant_option boolean")


def privileges_section(net: DataFrame, roles: list[str]) -> str:
    """ACL-12. The ROLES and PRIVILEGES sections of a baseline; grantees with the same privileges on an object share a statement."""
    shared: dict = defaultdict(list)
    held: dict = defaultdict(list)
    for r in net.orderBy("object", "grantee", "privilege").toLocalIterator():
        held[r.object, r.grantee, r.grant_option].append(r.privilege)
    for (name, grantee, option), privileges in held.items():
        shared[name, tuple(privileges), option].append(grantee)
    out = ["-- ROLES", *(f"CREATE ROLE {quoted(r)};" for r in sorted(roles)), "-- PRIVILEGES"]
    return "\n".join([*out, *(grant(list(p), name, grantees, option) for (name, p, option), grantees in sorted(shared.items()))]) + "\n"
