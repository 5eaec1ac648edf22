"""Invented statement texts, one per layout."""

KROO = """Kroo Current Account
A Person
Sort code: 11-22-33
Account number: 00112233
Total opening balance
£ 100.00
Account transactions
1 June 2026 to 30 June 2026
Date
Description
Out
In
Balance
02 June 2026
Card payment to Corner Shop
£12.50
£87.50
05 June 2026
From Employer Ltd
Salary June
£1,000.00
£1,087.50
Page
09 June 2026
Opening thing
£1,087.50
11 June 2026
Payment to Landlord
£500.00
£0.00
£587.50
Closing balance
£ 587.50
12 June 2026
After the end
£1.00
£2.00
"""

NATWEST_TRANSACTIONS = """NatWest
*****123 · 11-22-33
From  20/12/2025  To  19/01/2026
Your transactions
Date
Description
Type
Paid in
Paid out
28 Dec
CORNER SHOP
Debit card transaction
-£7.20
3 Jan
FRIEND
+£20.00
ignored afterwards
4 Jan
NO AMOUNT HERE
£12
6 Jan
REFUND
£3.00
Downloaded from the web
7 Jan
LATE
-£1.00
"""

NATWEST_STATEMENT = """Account Name
Account No
Sort Code
Page No
A PERSON
12345678
11-22-33
Period Covered
14 NOV 2025 to 13 FEB 2026
Previous Balance
£500.00
New Balance
£470.00
Date
Description
Paid In(£)
Withdrawn(£)
Balance(£)
14 NOV
BROUGHT FORWARD
500.00
20 NOV
CORNER SHOP
ROAD NAME
10.00
490.00
BAKERY
5.00
485.00
Date
Description
2 JAN
REFUND
15.00
500.00
10 FEB
RENT
30.00
470.00
RETSTMT 0001
IGNORED
1.00
2.00
"""

FIRSTDIRECT = """first direct Credit Card
4000 1111 2222 3333
Statement Date 05 May 2026
Previous Balance
100.00
New Balance
82.50
Your Transaction Details
Received By Us
Transaction Date
Details
Amount
08 Apr 26
GROCER TOWN
32.50
12 Apr 26
PAYMENT
THANK YOU
50.00CR
14 Apr 26
NOTHING
Outstanding Balance
"""

AMEX = """American Express Preferred Rewards
xxxx-xxxxxx-12345
From  20 December to 19 January 2026
Previous Closing Balance  New Credits  New Debits  Plan It Instalments Due  Closing Balance

£100.00 - £90.00 + £65.00 + £ 40.00 = £115.00

Dec 21   Dec 22   GROCER 55 TOWN   15.00
Jan 03   Jan 03   PAYMENT RECEIVED   60.00
CR
Jan 05   Jan 06   BOOK SHOP   45.00
New Plan It Instalments Created
Jan 04   INSTALMENT PLAN   30.00
Total of New Plan It Instalments Created   30.00
\f
New Plan It Instalments and Fees
Jan 04   INSTALMENT PLAN   30.00
Jan 19   INSTALMENT PLAN FEE   5.00
Total of New Instalment Plans and Fees   5.00
Plan It Instalments Summary
Jan 4 2026   BIG THING FROM SHOP
300.00   200.00   35.00   5.00   40.00   1 OF 3
9.00
Total   300.00
"""

VANGUARD = """A Person
Account number: VG123
Page 1 of 2
Your Regular Statement Vanguard
Your Vanguard account summary
Product
Value on 1 April 2026
Value on 1 July 2026
ISA
£900.00
£1,010.00
Personal
Pension
£10.00
£20.00
Account total
£910.00
£1,030.00
Your ISA investments at 1 July 2026
Description
Quantity
Price
Value
World Fund
Acc
10.00
£100.00
£1,000.00
Cash account
-
-
£10.00
Activity from 1 April 2026 to 1 July 2026 for your ISA
The transaction date is the date we carried out the activity.
Cash amount
02/04/2026
Regular payment
£250.00
£260.00
Issued by Vanguard Asset Management, a firm
London EC4N 8AF.
A Person
Account number: VG123
Page 2 of 2
03/04/2026
Bought World
Fund
-£250.00
£10.00
Your Personal Pension investments at 1 July 2026
Description
Cash account
-
-
£25.00
Activity from 1 April 2026 to 1 July 2026 for your Personal
Pension
"""

MONZO_PDF = """Monzo Personal Account statement
01/04/2026 - 30/06/2026
£70.00
Total balance
£55.00
Personal Account balance
Date
Description
(GBP) Amount
(GBP) Balance
29/06/2026
Coffee
Reference: x
-5.00
55.00
Sort code: 11-22-33
Account number: 87654321
28/06/2026
Friend
10.00
60.00
27/06/2026
Broken
10.00
Pot statement
26/06/2026
In a pot
1.00
2.00
"""

CHASE = """Chase Account statement
J.P. Morgan Europe Limited
Account number: 12312312
Sort code: 44-55-66
02 June 2026 - 30 June 2026
Opening balance
£10.00
Closing balance
£25.00
Date
Transaction details
Amount
Balance
02 Jun 2026
Opening balance
£10.00
05 Jun 2026
Wages
Payment
+£20.00
£30.00
Page 1 of 1
06 Jun 2026
Shop
-£5.00
£25.00
Some useful information
07 Jun 2026
Later
-£5.00
£20.00
"""

FLEX = """Flex statement
01/04/2026 - 30/06/2026
£80.00
Balance at start
£95.00
Balance at end
Date
Description
Debit
Credit
Balance
20/06/2026
Shoes
Amount: EUR 12.00. Conversion rate:
1.146245.
25.00
0.00
95.00
10/06/2026
Payment
0.00
10.00
70.00
This is legally prescribed text
"""

ALL = {
    "kroo": KROO, "natwest-transactions": NATWEST_TRANSACTIONS, "natwest-statement": NATWEST_STATEMENT,
    "firstdirect": FIRSTDIRECT, "amex": AMEX, "vanguard-pdf": VANGUARD, "monzo-pdf": MONZO_PDF,
    "chase": CHASE, "monzo-flex": FLEX,
}
