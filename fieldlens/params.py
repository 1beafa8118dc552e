"""Fixed parameters of the registered queries (viewer, dates, periods, paging).

Chosen from the driver's tables (FIXTURES.md §4): supplier 7 exists at every
scale factor and is a rep; supplier 0 is a manager; events span January 2024.
"""

from fieldlens.schema import LOST_REASON, REMINDER_MIDDLE, REMINDER_PREFIX
from fieldlens.session import Viewer

REP_ID = 7
MANAGER_ID = 0
REP = REP_ID
MANAGER = MANAGER_ID
MANAGER_IDS = {MANAGER_ID}
REP_VIEWER = Viewer(REP_ID, "NhanVien")
MANAGER_VIEWER = Viewer(MANAGER_ID, "QuanLy")

AS_OF = "2024-02-15"            # "today" for the 31-day report window and dashboard fallback
AS_OF_REMINDERS = "2024-01-02"  # a day on which some reps sent no report
PERIOD = "1998-03"              # an explicit dashboard / list period
SEARCH = "blue"                 # list search text (matches part names)
TENDER_STATUS = "ChoKetQua"
PAGE, PAGE_SIZE = 3, 15

LOST_REASON_SQL = LOST_REASON.replace("'", "''")
REMINDER_PREFIX_SQL = REMINDER_PREFIX.replace("'", "''")
REMINDER_MIDDLE_SQL = REMINDER_MIDDLE.replace("'", "''")
